"""The staging table as a stream: feed -> append-only table -> change stream.

The first hop appends every feed object to a Parquet table through Spark's file sink. Its
metadata log, a part of the table, lists the files of the batches that ended, so a batch
that a crash repeats is appended once and left-over files of a broken one are never read.
The second hop reads that table as a stream: it takes each file that the log lists once, and its
own checkpoint says how far it has come. Neither hop knows of the other, so either may stop,
crash and go on by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import STAGING

STAGED = StructType([*STAGING.fields, StructField("SOURCE_FILE", StringType())])
#: Name under which a feed's counts are observed.
COUNTS = "feed"


def counted(feed: DataFrame) -> DataFrame:
    """A streaming feed whose counts are observed on the way, batch by batch: rows, those
    without an id (G7) and those whose numbers of bikes or docks can't be (missing or below zero, C7)."""
    bikes, docks = F.col("NUM_BIKES_AVAILABLE"), F.col("NUM_DOCKS_AVAILABLE")
    bad = bikes.isNull() | docks.isNull() | (bikes < 0) | (docks < 0)
    return feed.observe(
        COUNTS,
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(F.col("STATION_ID").isNull(), 1)).alias("rejected"),
        F.count(F.when(bad, 1)).alias("invalid"),
    )


def observed(query: StreamingQuery, name: str = COUNTS) -> dict[str, int]:
    """The counts of a query's reported batches, added up (Spark keeps the last
    ``spark.sql.streaming.numRecentProgressUpdates`` of them)."""
    found: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        for k, v in (row.asDict() if row is not None else {}).items():
            found[k] = found.get(k, 0) + v
    return found


def start_staging(feed: DataFrame, path: str, checkpoint_location: str, processing_time: str | None = "5 minutes", available_now: bool = False) -> StreamingQuery:
    """First hop: append a streaming feed to the staging table, each row once (A4, A5)."""
    w = feed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def stream_staging(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, schema: StructType = STAGED) -> DataFrame:
    """Second hop's source: rows as the staging table gets them (G1)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)  # it may start before the first hop
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def mark_present(source: DataFrame, checkpoint_location: str) -> None:
    """Set a new checkpoint behind everything that the source holds now.

    One empty batch takes it all, whatever the source's limit for a batch, so the position is
    written as a whole: a crash before it ends leaves a batch that is marked again
    here, and once it is committed nothing is marked any more.
    """
    spark = source.sparkSession
    first = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_location.rstrip('/')}/commits/0")
    if first.getFileSystem(spark._jsc.hadoopConfiguration()).exists(first):
        return
    q = source.writeStream.foreachBatch(lambda batch, number: None).option("checkpointLocation", checkpoint_location).trigger(once=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
