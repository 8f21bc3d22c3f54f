"""Product codes of vectors by a dual-tree Lloyd iteration on integers.

A vector's components become integers, and the vector is cut into equal parts;
each part position has a codebook of its own. A round assigns every part to its
codebook's nearest entry and moves each entry to the mean of its parts.

Two trees meet in an assignment. The parts of a block of vectors lie in a
balanced k-d tree, built once and stored as an order: a node is a run of that
order, with its bounding box, sum and count. The codebook's entries lie in a second
one, down to single entries. Pairs of nodes go down both trees together: for each
node of parts, an entry node whose least box distance exceeds the smallest of
the greatest box distances holds no nearest entry of any of its parts and is
dropped. Where one entry is left, the node is assigned as a whole, by its cached
sum and count. Leaves that stay uncertain are decided part by part, by exact
integer distances to what is left. All bounds are integers too, and a pair is
dropped on a strict comparison only, so ties reach the leaves and go to the lower
index; results are those of the plain iteration, bit for bit.

On Spark: blocks of vectors are rows of a stored table; a round is one pass over
it whose tasks return sums by part and entry, combined before they are shuffled;
the driver sees one row an entry, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import release
from stationflow.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Vectors of a block, and parts of a leaf (about).
BLOCK = 4_096
LEAF = 16
#: Components stay below this, so that no squared distance of a vector leaves 64 bits.
LARGEST = 1 << 27


def finite(vector: Column | str) -> Column:
    """True for vectors that are not NULL and hold finite components only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd, F.lit(False))


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 x) of components, as 64-bit integers."""
    made = np.floor(SCALE * flat.astype(np.float64))
    if len(made) and np.abs(made).max() >= LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:g} have no 64-bit distances")
    return made.astype(np.int64)


def _bounds(n: int, levels: int) -> list[np.ndarray]:
    """Where the runs of each level of a balanced tree over ``n`` items begin and end."""
    found = [np.array([0, n])]
    for _ in range(levels):
        b = found[-1]
        made = np.empty(2 * len(b) - 1, np.int64)
        made[::2], made[1::2] = b, (b[:-1] + b[1:]) // 2
        found.append(made)
    return found


def _levels(n: int, leaf: int) -> int:
    """Levels below the root, such that no run is empty and the lowest hold about ``leaf`` items."""
    return max(0, (max(1, n // leaf)).bit_length() - 1)


def tree_order(points: np.ndarray, levels: int) -> np.ndarray:
    """For points (position, item, component): each position's items in the order of a
    k-d tree, whose nodes are split in the middle along their widest side."""
    positions, n, width = points.shape
    order = np.tile(np.arange(n), (positions, 1))
    if not width:
        return order
    for b in _bounds(n, levels)[:levels]:
        sorted_points = np.take_along_axis(points, order[:, :, None], 1)
        low, high = np.minimum.reduceat(sorted_points, b[:-1], 1), np.maximum.reduceat(sorted_points, b[:-1], 1)
        widest = np.repeat((high - low).argmax(2), np.diff(b), 1)
        key = np.take_along_axis(sorted_points, widest[:, :, None], 2)[:, :, 0]
        node = np.repeat(np.arange(len(b) - 1), np.diff(b))
        for p in range(positions):
            order[p] = order[p][np.lexsort((key[p], node))]
    return order


class Tree:
    """Boxes, sums and counts of the nodes of points that lie in tree order; node 0 is
    the root, the children of ``i`` are ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        bounds = _bounds(points.shape[1], levels)
        starts = bounds[-1][:-1]
        low, high, total = (f.reduceat(points, starts, 1) for f in (np.minimum, np.maximum, np.add))
        lows, highs, sums = [low], [high], [total]
        for _ in range(levels):
            low, high, total = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2]), total[:, ::2] + total[:, 1::2]
            lows.insert(0, low)
            highs.insert(0, high)
            sums.insert(0, total)
        self.low, self.high, self.sum = (np.concatenate(x, 1) for x in (lows, highs, sums))
        self.first = np.concatenate([b[:-1] for b in bounds])
        self.count = np.concatenate([np.diff(b) for b in bounds])
        self.lowest = (1 << levels) - 1  # the first node of the lowest level


class Codebook:
    """The tree over one position's entries, single ones at its leaves. Of equal entries only the first can be nearest."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1]) if entries.shape[1] else np.zeros(1, np.int64)
        levels = max(0, (len(first) - 1).bit_length())
        # Filled up to a power of two with the last entry; such doubles are dropped when a node is opened.
        self.index = np.concatenate([first, np.full((1 << levels) - len(first), first[-1])])
        order = tree_order(entries[self.index][None], levels)
        self.index = self.index[order[0]]
        self.tree = Tree(entries[self.index][None], levels)


def _box_distances(tree: Tree, p: np.ndarray, u: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between nodes of parts and boxes of entries."""
    a, b = tree.low[p, u], tree.high[p, u]
    gap = np.maximum(np.maximum(low - b, a - high), 0)
    reach = np.maximum(np.abs(high - a), np.abs(b - low))
    return (gap * gap).sum(1), (reach * reach).sum(1)


def assign(points: np.ndarray, codebooks: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Nearest entries of points (position, item, component) in tree order.

    Returns codes (position, item), the sums (position, entry, component) and counts
    (position, entry) of each entry's parts, and how many parts were assigned by nodes
    and by leaves.
    """
    positions, n, width = points.shape
    tree = Tree(points, levels)
    books = [Codebook(c) for c in codebooks]
    depth = max(b.tree.levels for b in books)
    # All positions' entry trees in one table, each brought to the same depth by its leaves.
    size = (1 << (depth + 1)) - 1
    low, high = np.zeros((positions, size, width), np.int64), np.zeros((positions, size, width), np.int64)
    entry, leaf = np.zeros((positions, size), np.int64), np.zeros((positions, size), bool)
    for p, b in enumerate(books):
        k = len(b.tree.count)
        low[p, :k], high[p, :k] = b.tree.low[0], b.tree.high[0]
        entry[p, b.tree.lowest : k], leaf[p, b.tree.lowest : k] = b.index, True
    codes = np.zeros((positions, n), np.int64)
    sums, counts = np.zeros((positions, codebooks.shape[1], width), np.int64), np.zeros((positions, codebooks.shape[1]), np.int64)
    work = {"by_node": 0, "by_leaf": 0}
    nodes = len(tree.count)
    p = np.arange(positions)
    u, e = np.zeros(positions, np.int64), np.zeros(positions, np.int64)
    while len(p):
        least, most = _box_distances(tree, p, u, low[p, e], high[p, e])
        key = p * nodes + u
        bound = np.full(positions * nodes, np.iinfo(np.int64).max)
        np.minimum.at(bound, key, most)
        stays = least <= bound[key]
        p, u, e, key = p[stays], u[stays], e[stays], key[stays]
        single = leaf[p, e]
        left = np.bincount(key, minlength=positions * nodes)[key]
        whole = single & (left == 1)
        if whole.any():
            wp, wu = p[whole], u[whole]
            c = entry[wp, e[whole]]
            np.add.at(sums, (wp, c), tree.sum[wp, wu])
            np.add.at(counts, (wp, c), tree.count[wu])
            many = tree.count[wu]
            where = np.repeat(tree.first[wu] - np.cumsum(many) + many, many) + np.arange(many.sum())
            codes[np.repeat(wp, many), where] = np.repeat(c, many)
            work["by_node"] += int(many.sum())
        lowest = u >= tree.lowest
        # A leaf whose entry nodes are all single is decided by integers.
        opened = np.zeros(positions * nodes, bool)
        opened[key[~single]] = True
        decide = lowest & ~whole & ~opened[key]
        if decide.any():
            done = _decide(points, codebooks, tree, p[decide], u[decide], entry[p[decide], e[decide]])
            dp, where, c = done
            codes[dp, where] = c
            np.add.at(sums, (dp, c), points[dp, where])
            np.add.at(counts, (dp, c), 1)
            work["by_leaf"] += len(c)
        rest = ~whole & ~decide
        p, u, e, single, lowest = p[rest], u[rest], e[rest], single[rest], lowest[rest]
        # Both nodes are opened where they can be; single entries and lowest nodes stay as they are.
        sides_u = [np.where(lowest, u, 2 * u + 1), np.where(lowest, -1, 2 * u + 2)]
        sides_e = [np.where(single, e, 2 * e + 1), np.where(single, -1, 2 * e + 2)]
        made = [(p, x, y) for x in sides_u for y in sides_e]
        p, u, e = (np.concatenate([m[i] for m in made]) for i in range(3))
        real = (u >= 0) & (e >= 0)
        p, u, e = p[real], u[real], e[real]
    return codes, sums, counts, work


def _decide(points: np.ndarray, codebooks: np.ndarray, tree: Tree, p: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, places and nearest entries of the parts of leaves, among candidate entries ``c``."""
    order = np.lexsort((c, u, p))
    p, u, c = p[order], u[order], c[order]
    begins = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (u[1:] != u[:-1])]))
    candidates = np.diff(np.append(begins, len(p)))
    p, u = p[begins], u[begins]
    many = tree.count[u]
    # One part after another, each with its leaf's candidates in ascending order.
    leaf = np.repeat(np.arange(len(p)), many)
    where = np.arange(len(leaf)) + np.repeat(tree.first[u] - np.cumsum(many) + many, many)
    widths = candidates[leaf]
    ends = np.cumsum(widths)
    c = c[np.arange(ends[-1]) + np.repeat(begins[leaf] - ends + widths, widths)]
    part = p[leaf]
    rp = np.repeat(part, widths)
    gap = points[rp, np.repeat(where, widths)] - codebooks[rp, c]
    distance = np.einsum("ij,ij->i", gap, gap)
    nearest = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, ends - widths), widths))
    return part, where, c[nearest[np.searchsorted(nearest, ends - widths)]]


def _blocks(vectors: DataFrame, id_type: T.DataType, label_type: T.DataType, width: int, parts: int) -> DataFrame:
    """Stored rows of up to ``BLOCK`` vectors of (id, label, vector): ids, labels, and the parts in tree order with that order."""
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("labels", T.ArrayType(label_type)),
            T.StructField("points", T.BinaryType()),
            T.StructField("order", T.BinaryType()),
        ]
    )

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column("vector")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        n = rows.num_rows
        points = integers(flat).reshape(n, parts, width // parts).transpose(1, 0, 2)
        order = tree_order(points, _levels(n, LEAF))
        points = np.take_along_axis(points, order[:, :, None], 1)
        one = [pa.array([0, n], pa.int32())]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(one[0], rows.column("id")),
                pa.ListArray.from_arrays(one[0], rows.column("label")),
                pa.array([points.astype("<i4").tobytes()], pa.binary()),
                pa.array([order.astype("<u2").tobytes()], pa.binary()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if rows + part.num_rows > BLOCK:
                    yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        held, batch = [], None
        release()

    return cut_lineage(vectors.mapInArrow(run, schema), "blocks")


def _read_block(points: bytes, order: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(order, "<u2").astype(np.int64).reshape(parts, -1)
    return np.frombuffer(points, "<i4").astype(np.int64).reshape(parts, places.shape[1], -1), places


def _moved(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: the codebooks with each used entry at the floor of its parts' mean."""
    parts, entries, width = codebooks.shape
    schema = "part int, entry int, n long, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for points, order in zip(batch.column("points").to_pylist(), batch.column("order").to_pylist(), strict=True):
                block, places = _read_block(points, order, parts)
                _, s, c, _ = assign(block, codebooks, _levels(places.shape[1], LEAF))
                sums += s
                counts += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    found = blocks.select("points", "order").mapInArrow(run, schema)
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    moved = codebooks.copy()
    for row in totals.collect():  # a row an entry at most
        moved[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return moved


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def learn(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after that many rounds over stored blocks."""
    for _ in range(rounds):
        codebooks = _moved(blocks, codebooks)
    return codebooks


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per usable vector: the id, ``code`` (two hexadecimal digits a part),
    ``error`` (squared distances to its entries, summed over the parts), ``label_error``
    (errors summed over equal labels, NULLs together) and ``codebooks_sha256``.

    Vectors that are NULL or hold NULL or non-finite components are left out, as are those of
    another length than the vector of the smallest id (in proper tables there are none);
    that length must be a multiple of ``parts``. The codebooks start as the vectors of the
    ``entries`` smallest ids; of rows with one id, the smaller vector comes first, and each
    repeated row counts. Rows with a NULL id are coded but don't start an entry (without
    any id there is nothing to start from: no rows). Fewer vectors than ``entries`` make that many
    entries. Ties go to the lower index. An empty table gives no rows. Other columns are left
    out, whatever their names. Components of 2^19 or more raise an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(finite("vector"))
    first = rows.where("id is not null").orderBy("id", "vector").limit(entries).collect()
    width = len(first[0]["vector"]) if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    start = [r["vector"] for r in first if len(r["vector"]) == width]
    codebooks = integers(np.array(start, np.float64).ravel()).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    rows = rows.where((F.size("vector") == width) if first else F.lit(False))
    blocks = _blocks(rows, id_type, label_type, width, parts)
    codebooks = np.ascontiguousarray(codebooks)
    if first:
        codebooks = learn(blocks, codebooks, rounds)
    digest = codebooks_digest(codebooks)
    hexadecimal = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, places = _read_block(batch.column("points")[i].as_py(), batch.column("order")[i].as_py(), parts)
                sorted_codes, _, _, _ = assign(block, codebooks, _levels(places.shape[1], LEAF))
                gap = block - np.take_along_axis(codebooks, sorted_codes[:, :, None], 1)
                codes, errors = np.empty_like(sorted_codes), np.empty_like(sorted_codes)
                np.put_along_axis(codes, places, sorted_codes, 1)
                np.put_along_axis(errors, places, (gap * gap).sum(2), 1)
                text = ["".join(c) for c in hexadecimal[codes.T].tolist()]
                ids, labels = batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors.sum(0))], names=out.names)

    coded = cut_lineage(blocks.mapInArrow(run, out), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
