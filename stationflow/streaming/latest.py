"""The latest row per station kept by a stateful stream.

The stream's own state holds each station's greatest row by event time, in RocksDB on the
executors and in the checkpoint: ``max`` of a struct, partial before the shuffle. A batch reads
and writes the keys that it brings, and in update mode only stations whose latest row
may have changed leave the operator. Those are appended as a published part, so no batch
rewrites the state. Reading takes each station's row of the newest part; ``fold`` makes one part of many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.status import latest_per_station
from .commits import CommitLog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestTable:
    """Parts of changed stations under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def append(self, changes: DataFrame, query: str, batch: int) -> None:
        """A batch's changed stations; one that is there already is left as it is."""
        if not any((e.get("query"), e.get("batch")) == (query, batch) for _, e in self.log.entries()):
            self.log.write(changes, query=query, batch=int(batch))

    def _parts(self) -> list[tuple[int, dict]]:
        entries = self.log.entries()
        folded = max((n for n, e in entries if e.get("folded")), default=-1)
        return [(n, e) for n, e in entries if n > folded or n == folded]

    def read(self) -> DataFrame | None:
        """Every station's latest row; None before the first part."""
        paths = [f"{self.log.root}/{e['path']}" for _, e in self._parts()]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(\d+)-", 1).cast("long")
        return latest_per_station(rows.withColumn("_part", part), ("_part",)).drop("_part")

    def fold(self) -> None:
        """One part of all; the parts before stay listed, so that a batch that comes again is known."""
        rows = self.read()
        if rows is not None:
            self.log.write(rows, folded=True)


def start_latest(
    source: DataFrame,
    root: str,
    checkpoint_location: str,
    order_by: Sequence[str] = ("LAST_REPORTED",),
    processing_time: str | None = "5 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Keep each station's greatest ``order_by`` row of a streaming feed in a ``LatestTable``.

    Rows without an id are dropped. Equal ``order_by`` values are decided as in ``latest_per_station``.
    The result doesn't depend on how the feed is cut into batches.
    """
    spark = source.sparkSession
    table = LatestTable(spark, root)

    def run(changes: DataFrame, number: int) -> None:
        stream = changes.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.append(changes, stream or checkpoint_location, number)

    w = latest_per_station(source, order_by).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a stream takes it when it starts
    try:
        return w.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
