"""Token ids of documents in ORC files.

Each task writes one file: its documents in ascending id order, one row each.
ORC run-length-encodes the ids as integers, cuts a file into stripes that tasks
read on their own, and keeps a row index and Bloom filters of the document ids,
so that a look-up skips files, stripes and row groups by their metadata.

Columns of a file: the id column, ``shard`` (the file's place in id order),
``shard_start`` (ids of the file before the document), ``n_tokens``, ``ids``.
A document's place in the whole corpus is its shard's base, a running sum over
one row a file, plus ``shard_start``; so no task has to wait for another.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import map_texts, steps_of_bytes
from stationflow.llm.tokens import TOKEN_STEP, encoder

#: The id that ends each document.
END_ID = 2
STRIPE_BYTES = 16 << 20
ROWS_INDEXED = 1_000


def end_each(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document's, and their numbers."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def crc_of_lists(lists: pa.ListArray) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    ends = lists.offsets.to_numpy()
    data = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, compression: str = "lz4"
) -> None:
    """Write every document's ids, with ``end_id`` after them, to ORC files under ``path``.

    NULL and empty texts are documents of ``end_id`` alone. NULL ids come first;
    rows of one id stand one after another in the order in which they are read.
    An empty table gives files without rows. Other columns aren't written. A very long
    text is one row, encoded whole (about 20 bytes of memory a byte of text).
    """
    # The place in the input deals an id that many rows share out over several ranges.
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col(id_col).asc_nulls_first(), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "text")

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        texts = encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        written = 0

        def work(part: pa.Array) -> list[pa.Array]:
            nonlocal written
            ids, lengths = end_each(*texts.encode(part), end_id)
            ends = np.cumsum(lengths)
            starts = written + ends - lengths
            written += int(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
            return [pa.array(np.full(len(lengths), shard, np.int32)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), lists]

        return work

    fields = [
        T.StructField("shard", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
    made = map_texts(rows, "text", fields, make, drop_text=True, size=TOKEN_STEP)
    (
        made.write.option("orc.compress", compression)
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROWS_INDEXED))
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with ``start``, the ids of all documents before each."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file, so its size is bounded by the number of tasks that wrote.
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def look_up(spark: SparkSession, path: str, ids: Iterable[int], id_col: str = "doc_id") -> DataFrame:
    """Some documents' rows; the filter reaches the row index and the Bloom filters."""
    return spark.read.orc(path).where(F.col(id_col).isin(list(ids)))


def with_crc(rows: DataFrame) -> DataFrame:
    """``ids_crc32`` instead of ``ids``."""
    keep = [c for c in rows.columns if c not in ("ids", "ids_crc32")]
    rows = rows.select(*keep, "ids")
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + [T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps_of_bytes(batch, "ids", 4, 16_000_000):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), crc_of_lists(part.column("ids"))], names=schema.names)

    return rows.mapInArrow(run, schema)
