"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (the signs of
random projections) and the vectors of a label are ordered by it. The order is
cut into blocks; a vector is compared with its own block and the two beside
it, which is its window. Near vectors agree in most bits, so in some pass they
lie in one window; the pairs that the passes verify are united.

A pair that several passes compare counts once, without a table of pairs: every
vector carries its block of every pass, so a window knows whether an earlier
pass has compared a pair already. A window returns a row per vector (its new links
and one edge), never its pairs. Equal vectors are one class with a count; they
aren't compared with each other.

Equal keys are ordered by a hash of their own in each pass, so that the windows of
a mass of near vectors hold other members each time. A component that is larger
than a block can have links outside its windows: its links are counted anew, by
comparing all its members shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.components import connected_components
from stationflow.session import cut_lineage

COSINE = 0.98
PASSES = 12
BITS = 48
BLOCK = 512
#: Vectors of a crowded component that one task compares with as many others; smaller components are dealt out too.
SHARD = 8_192
LEAST_SHARD = 256
SPREAD = 16


def usable(vector: Column | str) -> Column:
    """True for vectors that are not NULL, not zero and hold finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; angles stay exactly."""
    _, exponent = np.frexp(np.abs(x).max(1))
    return np.ldexp(x, -exponent[:, None])


def _keys(classes: DataFrame, passes: int, bits: int) -> DataFrame:
    """(cls, label, dim, pass, key): a row for each pass."""
    schema = T.StructType([classes.schema["cls"], classes.schema["label"]] + [T.StructField(n, T.LongType()) for n in ("dim", "pass", "key")])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([dim, passes, bits]).standard_normal((dim, passes * bits))
                signs = scaled(vectors_of(part.column("vector"))) @ planes[dim] > 0
                keys = signs.reshape(len(part), passes, bits) @ weights
                for p in range(passes):
                    fixed = [pa.array(np.full(len(part), v, np.int64)) for v in (dim, p)]
                    yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("label"), *fixed, pa.array(keys[:, p])], names=names)

    return classes.select("cls", "label", "vector").mapInArrow(run, schema)


def _blocks(keys: DataFrame, size: int) -> DataFrame:
    """(cls, pass, block). Blocks that follow one another in an order have numbers
    that do; between labels, passes and partitions a number is left out."""
    order = ["pass", "label", "dim", "key", "tie", "cls"]
    rows = keys.withColumn("tie", F.xxhash64("cls", "pass")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([keys.schema["cls"], T.StructField("pass", T.LongType()), T.StructField("block", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pass", "label", "dim")]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            made = np.empty(len(batch), np.int64)
            for start, end in zip([0, *changes.tolist()], [*changes.tolist(), len(batch)], strict=True):
                group = tuple(c[start] for c in cols)
                if group != last:
                    block, filled, last = block + 2, 0, group
                at = filled + np.arange(end - start)
                made[start:end] = block + at // size
                block, filled = int(block + (filled + end - start) // size), (filled + end - start) % size
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("pass"), pa.array(made)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _compare(key: tuple, group: pa.Table, least: float) -> pa.Table:
    """New links of one window: the block itself (``own``) and the next one."""
    number = key[0].as_py()
    group = group.combine_chunks()
    cls, count = (group.column(c).to_numpy() for c in ("cls", "n"))
    blocks = np.stack(group.column("blocks").to_numpy(zero_copy_only=False))
    x = scaled(vectors_of(group.column("vector").combine_chunks()))
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    order = int(group.column("pass")[0].as_py())
    own = np.flatnonzero(blocks[:, order] == number)
    found_a, found_b = [], []
    step = max(1, 4_000_000 // max(1, len(cls)))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        a, b = np.nonzero(unit[rows] @ unit.T >= least - 1e-9)
        a = rows[a]
        # a pair inside the block is met from both ends
        once = (a < b) | (blocks[b, order] != number) & (a != b)
        a, b = a[once], b[once]
        if order and len(a):
            seen = np.zeros(len(a), bool)
            for q in range(order):
                seen |= np.abs(blocks[a, q] - blocks[b, q]) <= 1
            a, b = a[~seen], b[~seen]
        for s in range(0, len(a), 200_000):
            i, j = a[s : s + 200_000], b[s : s + 200_000]
            good = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
            found_a.append(i[good])
            found_b.append(j[good])
    a = np.concatenate([np.zeros(0, np.int64), *found_a])
    b = np.concatenate([np.zeros(0, np.int64), *found_b])
    weight = np.bincount(a, count[b], len(cls)) + np.bincount(b, count[a], len(cls))
    root = np.arange(len(cls))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    hit = np.flatnonzero(weight)
    return pa.table({"cls": cls[hit], "links": weight[hit].astype(np.int64), "other": cls[root[hit]]})


def _count(key: tuple, group: pa.Table, least: float) -> pa.Table:
    """Links between two shards of a component, or within one, counted per vector."""
    low, high = key[1].as_py(), key[2].as_py()
    group = group.combine_chunks()
    cls, count, shard = (group.column(c).to_numpy() for c in ("cls", "n", "shard"))
    x = scaled(vectors_of(group.column("vector").combine_chunks()))
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    own, other = np.flatnonzero(shard == low), np.flatnonzero(shard == high)
    across = unit[other].T
    n = count.astype(np.float64)  # whole numbers below 2 ** 53
    weight = np.zeros(len(cls))
    step = max(1, 4_000_000 // max(1, len(other)))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        cosine = unit[rows] @ across
        near = cosine >= least - 1e-9
        # only what rounding can decide is computed again
        a, b = np.nonzero(near & (cosine < least + 1e-9))
        for s in range(0, len(a), 200_000):
            i, j = a[s : s + 200_000], b[s : s + 200_000]
            p, q = rows[i], other[j]
            near[i, j] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= least
        if low == high:
            near[np.arange(len(rows)), at + np.arange(len(rows))] = False
        near = near.astype(np.float64)
        weight[rows] += near @ n[other]
        if low != high:
            weight[other] += n[rows] @ near
    return pa.table({"cls": cls, "links": weight.astype(np.int64)})


def _recount(crowded: DataFrame, least: float, size: int) -> DataFrame:
    """(cls, links) of all members of the components given by ``root`` and ``members``."""
    shards = F.greatest(F.ceil(F.col("members") / size), F.least(F.ceil(F.col("members") / LEAST_SHARD), F.lit(SPREAD)))
    dealt = crowded.select("root", "cls", "n", "vector", shards.alias("shards")).withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    dealt = dealt.select("root", F.least("shard", "with").alias("low"), F.greatest("shard", "with").alias("high"), "cls", "n", "vector", "shard")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "links")])

    def count(key: tuple, group: pa.Table) -> pa.Table:
        return _count(key, group, least)

    return dealt.groupBy("root", "low", "high").applyInArrow(count, schema).groupBy("cls").agg(F.sum("links").alias("exact"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = COSINE,
    passes: int = PASSES,
    bits: int = BITS,
    block: int = BLOCK,
    shard: int = SHARD,
) -> DataFrame:
    """One row per vector: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label (not NULL) and length link at a cosine of ``least`` or
    more. Unusable vectors (NULL, zero, NULL or non-finite components) and those
    without a label link with nothing: they are their own component and kept.
    ``n_links`` counts rows, so repeated rows link with each other.
    ``component_id`` is the smallest id reachable, NULL ids left out; ``kept`` says
    whether that is the row's own (both NULL included). An empty table gives no
    rows; other columns are left out.
    """
    rows = vectors.select(F.col(id_col), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = usable("vector") & F.col("label").isNotNull()
    classes = rows.where(good).groupBy("label", "vector").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    placed = _blocks(_keys(classes, passes, bits), block)
    placed = placed.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pass", "block"))).alias("placed"))
    placed = placed.select("cls", F.transform("placed", lambda x: x["block"]).alias("blocks"))
    placed = cut_lineage(classes.select("cls", "n", "vector").join(placed, "cls"), "placed")
    windows = placed.select("*", F.posexplode("blocks").alias("pass", "of")).withColumn("window", F.explode(F.array(F.col("of"), F.col("of") - 1)))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "links", "other")])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        return _compare(key, group, least)

    found = windows.select("window", "pass", "cls", "n", "vector", "blocks").groupBy("window").applyInArrow(compare, schema)
    found = cut_lineage(found, "links")

    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    of = classes.join(totals, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    of = of.withColumn("root", F.coalesce("root", "cls"))
    first = of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = cut_lineage(of.join(first, "root").select("cls", "label", "vector", "n", "links", "root", "component_id", "members"), "components")
    recounted = cut_lineage(_recount(named.where(F.col("members") > block), least, shard), "recounted")
    n_links = F.coalesce("exact", "links", F.lit(0)) + F.col("n") - 1
    named = named.join(recounted, "cls", "left").select("label", "vector", "component_id", n_links.alias("n_links"))
    linked = rows.where(good).join(named, ["label", "vector"]).select(id_col, "n_links", "component_id")
    alone = rows.where(~good).select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
