"""Broken docks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

RESULT_COLUMNS = ["STATION_ID", "STATION_NAME", "ADDRESS", "LAT", "LON", "BROKEN_DOCKS"]
# Fixed values from the reference: strict threshold and result cap of the dashboard list.
DEFAULT_MIN_BROKEN = 1
DEFAULT_TOP_K = 10


def broken_docks(master: DataFrame, state: DataFrame) -> DataFrame:
    """Master LEFT JOIN current state, kept where usable docks < capacity (F1).

    The filter rejects NULL usable docks, so Catalyst turns the outer join into
    an inner one. The result is unordered; order at the consumer.
    """
    m = master.select("STATION_ID", F.col("CAPACITY").alias("TOTAL_DOCKS"), "STATION_NAME", "ADDRESS", "LAT", "LON")
    cur = state.select("STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE")
    broken = C.broken_docks("TOTAL_DOCKS", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE")
    return (
        m.join(cur, "STATION_ID", "left")
        .where(C.usable_docks("NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE") < F.col("TOTAL_DOCKS"))
        .select(
            "STATION_ID",
            "STATION_NAME",
            "ADDRESS",
            "LAT",
            "LON",
            broken.alias("BROKEN_DOCKS"),
        )
    )


def top_broken_docks(df: DataFrame, min_broken: int = DEFAULT_MIN_BROKEN, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Stations with more than ``min_broken`` broken docks, worst ``k`` first.

    Ties are broken by station id so the result is reproducible; the plan is a
    single TakeOrderedAndProject (per-partition top-k, then a k-row merge).
    """
    return (
        df.where(F.col("BROKEN_DOCKS") > min_broken)
        .orderBy(F.col("BROKEN_DOCKS").desc(), F.col("STATION_ID").asc())
        .limit(k)
    )


def broken_docks_list(df: DataFrame) -> DataFrame:
    """Name and count for the list panel."""
    return df.select("STATION_NAME", "BROKEN_DOCKS")
