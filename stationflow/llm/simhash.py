"""Near duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint holds 64 majority bits of the hashes of a text's word shingles.
Equal fingerprints are one class; the rest of the work is on distinct ones.

Each fingerprint gets its row of the pivot table: its Hamming distances to
reference fingerprints. By the triangle inequality two fingerprints within
``bits`` differ by at most that in every coordinate. The references are a base
r and, for each of 32 disjoint pairs of bits, r with that pair flipped; and some
random ones. The distances to r and to r with a pair flipped give the distance
on that pair alone, and two fingerprints within two bits differ on two pairs at
most. So with the pairs dealt into four groups, two groups of coordinates are
equal: fingerprints that share the coordinates of two groups are candidates.
Of these, a pair whose largest coordinate difference is over the limit is
discarded, and the survivors are verified by their bits.

A set of candidates above ``SMALL`` members (a mass of near copies) is not paired
out. Its fingerprints are joined exactly by their neighbourhoods: two are
within two bits just if some 64-bit word is within one bit of both, and at most
65 fingerprints lie that near to one word.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import map_texts, with_marks
from stationflow.llm.components import connected_components
from stationflow.session import cut_lineage

WORDS = 3
BITS = 2
SEED = 42
SMALL = 64
GROUPS = 4
#: Random references besides the structured ones.
RANDOM_PIVOTS = 8
_RANDOM = random.Random(20)
PIVOTS = [_RANDOM.getrandbits(64) - (1 << 63) for _ in range(RANDOM_PIVOTS)]
BASE = _RANDOM.getrandbits(64) - (1 << 63)


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text (no words or NULL: 0)."""
    parts = text.lower().split() if text else []  # of bytes: just A-Z, just ASCII white space
    if not parts:
        return 0
    whole = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(whole, SEED)]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(lengths)
        first = (ends - lengths)[: len(parts) - words + 1].tolist()
        hashes = [digest(whole[i:j], SEED) for i, j in zip(first, (ends[words - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        part = np.array(hashes[at : at + 100_000], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    """``docs`` without the text and with the fingerprint ``out`` (signed long)."""

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        return lambda part: [pa.array([fingerprint(t, words) for t in part.cast(pa.binary()).to_pylist()], pa.int64())]

    return map_texts(docs, text_col, [T.StructField(out, T.LongType())], make, drop_text=True)


def _distance(x: Column | str, reference: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.bit_count(x.bitwiseXOR(F.lit(reference).cast("long")))


def _signed(word: int) -> int:
    return (word + (1 << 63)) % (1 << 64) - (1 << 63)


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` with ``near`` (distances to the random references) and, for each two
    groups of coordinates, a row with the number ``band`` and their values ``key``."""
    pairs = list(range(0, 64, 2))
    random.Random(7).shuffle(pairs)
    base = _distance("fp", BASE)
    flipped = [_distance("fp", _signed(BASE ^ (3 << p))) for p in pairs]
    # d(x, r) - d(x, r with the pair flipped) + 2 is twice the bits of the pair in which x differs from r.
    columns = {f"c{i}": (base - d + 2) / 2 for i, d in enumerate(flipped)}
    coordinates = fps.select("fp", *[c.cast("int").alias(n) for n, c in columns.items()], *[_distance("fp", p).alias(f"p{i}") for i, p in enumerate(PIVOTS)])

    def packed(groups: tuple[int, ...]) -> Column:
        # Base 3 would do; two bits a coordinate are as exact.
        value = F.lit(0).cast("long")
        for i in range(len(pairs)):
            if i % GROUPS in groups:
                value = value * 4 + F.col(f"c{i}")
        return value

    bands = [F.struct(F.lit(i).alias("band"), packed(g).alias("key")) for i, g in enumerate(combinations(range(GROUPS), GROUPS - BITS))]
    near = F.array(*[F.col(f"p{i}").cast("byte") for i in range(len(PIVOTS))])
    rows = coordinates.select("fp", near.alias("near"), F.explode(F.array(*bands)).alias("of"))
    return rows.select("fp", "near", "of.band", "of.key")


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints ``fp`` within two bits, distinct ones given."""
    table = pivot_table(fps)
    sizes = cut_lineage(table.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    members = cut_lineage(table.join(sizes, ["band", "key"]), "candidates")
    some = members.where(F.col("n") <= small)
    left, right = (some.select("band", "key", F.col("fp").alias(x), F.col("near").alias(f"near_{x}")) for x in "ab")
    coordinate = F.greatest(*[F.abs(F.col("near_a")[i] - F.col("near_b")[i]) for i in range(len(PIVOTS))])
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["band", "key"]).where((F.col("a") < F.col("b")) & (coordinate <= BITS) & (bits <= BITS)).select("a", "b")

    crowded = members.where(F.col("n") > small).select("fp").distinct()
    words = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])
    near = crowded.select("fp", F.explode(words).alias("word"))
    first = F.min("fp").over(Window.partitionBy("word"))  # 65 rows a word at most
    balls = near.select(F.col("fp").alias("a"), first.alias("b")).where("a <> b")
    return pairs.union(balls).distinct()


def _components(rows: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows, stored, with a fingerprint ``fp`` in place of the text; and (fp, root, component_id) of the distinct ones, stored."""
    rows = cut_lineage(fingerprints(rows, text_col, "fp", words), "fingerprints")
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    roots = connected_components(links(classes.select("fp")))
    of = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, cut_lineage(of.join(first, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    ``component_id`` is the smallest id that a chain of links (``BITS`` or fewer
    differing bits) reaches. NULL, empty and blank texts have fingerprint zero
    and link like any other. NULL ids are never the smallest; a component
    of NULL ids alone has a NULL id. Repeated rows stay, one row each; an empty
    table gives none; other columns are left out. A very long text is read whole, its hashes
    are counted 100,000 at a time.
    """
    rows, named = _components(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, words)
    found = rows.join(named, "fp")  # two stored tables: Spark splits a fingerprint that many documents share
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame) -> DataFrame:
    """(of, file, place): every column of stored ``docs`` as a struct, and where each row lies.

    A table that was read from Parquet says it itself; anything else is stored first, so
    that a task that runs again meets the same places."""
    of = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of")
    for table in (lambda: docs, lambda: cut_lineage(docs, "placed")):
        try:
            stored = table()
            where = stored.metadataColumn("_metadata")
            return stored.select(of, where["file_path"].alias("file"), where["row_index"].alias("place"))
        except AnalysisException:  # not a scan of Parquet files
            continue
    raise ValueError("the rows have no places")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest id.

    Of rows that share that id, the first by its file and place stays; a NULL id comes after
    all others. Texts stay where they are: the rows to go are found by their places, and only
    rows that a bitmap of these lets through are joined with them. Every column stays as it is,
    whatever its name; an empty table stays empty.
    """
    stored = _placed(docs)
    rows = stored.select(F.col("of")[id_col].alias("id"), F.col("of")[text_col].alias("text"), "file", "place")
    rows, named = _components(rows, "id", "text", WORDS)
    # Reduced per fingerprint first: a fingerprint that many documents share is no hot key.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "place"))
    of_fp = rows.groupBy("fp").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).join(named.select("fp", "root"), "fp")
    best = of_fp.groupBy("root").agg(F.min("best").alias("best"), F.sum("n").alias("n")).where("n > 1")
    kept = cut_lineage(of_fp.select("fp", "root").join(best, "root").select("fp", "best.file", "best.place"), "kept")
    several = rows.select("fp", "file", "place").join(kept.select("fp", F.col("file").alias("best_file"), F.col("place").alias("best_place")), "fp")
    gone = cut_lineage(several.where("file <> best_file or place <> best_place").select("file", "place"), "gone")
    key = F.struct("file", "place")
    marked = with_marks(stored, key, gone, key, "maybe")
    sure = marked.where("not maybe").select("of")
    others = marked.where("maybe").join(gone, ["file", "place"], "left_anti").select("of")
    return sure.unionByName(others).select("of.*")
