"""Shared pieces of the training-data operators: tables, folds, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one step of a Python task works on (a longer single text makes a step of its own).
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5 (fold 0 is held out); NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def held_out(id_col: str = "doc_id") -> Column:
    """True where the fold is 0; a NULL id is not held out (and not learned from either)."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns whose names an operator is about to write (case-insensitive, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Bits of a marker: 4 MB, whatever is marked.
MARKER_BITS = 1 << 25


def with_marks(rows: DataFrame, key: Column, marked: DataFrame, marked_key: Column, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: true for every row whose key is one of ``marked``, and for a few others.

    The marker is a bitmap over hashes of fixed size, so it can be broadcast; what it lets
    through has to be compared exactly."""
    at = F.pmod(F.xxhash64(marked_key), F.lit(MARKER_BITS))
    bits = marked.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    own = F.pmod(F.xxhash64(key), F.lit(MARKER_BITS))
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(own) == F.col("_bucket"), "left")
    place = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mark = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    return found.withColumn(name, mark).drop("_bucket", "_bits")


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` of at most ``size`` bytes of text (one row at least)."""
    yield from _cut(batch, pc.binary_length(batch.column(column)), size)


def steps_of_bytes(batch: pa.RecordBatch, column: str, width: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same by the bytes of a list column whose items take ``width`` each."""
    yield from _cut(batch, pc.multiply(pc.list_value_length(batch.column(column)), width), size)


def _cut(batch: pa.RecordBatch, lengths: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, rows = 0, batch.num_rows
    while start < rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Give a task's freed memory back to the system: its worker stays for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    drop_text: bool = False,
    size: int = STEP_CHARS,
) -> DataFrame:
    """``df`` with the columns ``fields`` that a task's function gives for arrays of
    texts. ``make`` runs once a task. Columns of the same names are replaced.
    Rows are independent, and a task works on one step of texts at a time."""
    df = without(df, [f.name for f in fields])
    keep = [c for c in df.columns if not (drop_text and c == text_col)]
    out = T.StructType([f for f in df.schema.fields if f.name in keep] + list(fields))
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in steps(batch, text_col, size):
                made = work(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=names)
        work = batch = part = made = None
        release()

    return df.mapInArrow(run, out)



def keep_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]], size: int = STEP_CHARS) -> DataFrame:
    """The rows of ``df`` whose texts a task's function marks True; every column stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in steps(batch, text_col, size):
                yield part.filter(pa.array(keep(part.column(text_col))))
        keep = batch = part = None
        release()

    return df.mapInArrow(run, df.schema)
