"""Sinks (A5, A7, A11, A15, A16)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Objects of one snapshot file: some 16 MB, which a task reads and parses as a whole.
SNAPSHOT_OBJECTS = 50_000


def append_staging(df: DataFrame, path: str) -> None:
    """Append loaded rows to the staging table (A5)."""
    df.write.mode("append").parquet(path)


def to_feed_shape(staging: DataFrame) -> DataFrame:
    """Staging columns back to feed field names (the nested bike types included)."""
    return staging.select(
        F.col("STATION_ID").alias("station_id"),
        F.col("NUM_BIKES_AVAILABLE").alias("num_bikes_available"),
        F.struct(
            F.col("NUM_BIKES_AVAILABLE_MECHANICAL").alias("mechanical"),
            F.col("NUM_BIKES_AVAILABLE_EBIKE").alias("ebike"),
        ).alias("num_bikes_available_types"),
        F.col("NUM_DOCKS_AVAILABLE").alias("num_docks_available"),
        F.col("LAST_REPORTED").alias("last_reported"),
        F.col("IS_CHARGING_STATION").alias("is_charging_station"),
        F.col("STATUS").alias("status"),
        F.col("IS_INSTALLED").alias("is_installed"),
        F.col("IS_RENTING").alias("is_renting"),
        F.col("IS_RETURNING").alias("is_returning"),
        F.col("TRAFFIC").alias("traffic"),
    )


def write_snapshot_json(df: DataFrame, base: str, stamp: str) -> str:
    """One poll snapshot as ``<base>/stations_<stamp>/``: each file is a JSON array
    with an object a line, as the feed's own files are (A7).

    ``stamp`` is ``%Y%m%d_%H%M%S``; an existing snapshot is never overwritten.
    Each task streams its rows into files of ``SNAPSHOT_OBJECTS`` objects, because
    an array is read as a whole: every so many lines one array ends and the next begins.
    """
    path = f"{base.rstrip('/')}/stations_{stamp}"
    size = SNAPSHOT_OBJECTS

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0  # the last line isn't known to be one until the rows end
        for batch in batches:
            lines = []
            for row in batch.column(0).to_pylist():
                if held is not None:
                    lines.append(held + "]" if n % size == 0 else held)
                held = ("[" if n % size == 0 else ",") + row
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + "]"])], names=["value"])

    objects = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    objects.mapInArrow(arrays, "value string").write.mode("errorifexists").option("maxRecordsPerFile", size).text(path)
    return path


def materialise(df: DataFrame, path: str) -> DataFrame:
    """CREATE OR REPLACE TABLE ... AS SELECT (A11): write, then read the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result-shaped CSV: header, UTF-8, fields with commas quoted."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def collect_result(df: DataFrame, max_rows: int) -> pd.DataFrame:
    """Bounded fetch to the client (A16): the whole result, or an error if it has more than ``max_rows`` rows."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    found = df.limit(max_rows + 1).toPandas()
    if len(found) > max_rows:
        raise ValueError(f"the result has more than {max_rows} rows")
    return found
