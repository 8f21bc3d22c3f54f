"""Status enrichment and latest-per-station.

At scale the status history is the big table (every poll of every station)
and the master is a small dimension. ``current_state`` therefore reduces the
history to one row per station *first* -- a hash-partitioned aggregate with a
map-side partial step, so a station holding a third of all polls is reduced
inside each map task before anything is shuffled -- and only then joins the
station-sized result with the master.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import STATE, STATE_COLUMNS

KEY = "STATION_ID"
MASTER_COLUMNS = ["STATION_ID", "STATION_NAME", "LAT", "LON", "CAPACITY"]


def valid_status(status: DataFrame) -> DataFrame:
    """Rows with a usable key. NULL ids never match a MERGE key and would be
    re-inserted on every refresh, so they are dropped (G7); count them with
    :func:`rejected_status`."""
    return status.where(F.col(KEY).isNotNull())


def rejected_status(status: DataFrame) -> DataFrame:
    return status.where(F.col(KEY).isNull())


def latest_per_station(
    status: DataFrame,
    order_by: Sequence[str] = ("LAST_REPORTED", "TST_REC"),
    key: str = KEY,
    with_counts: bool = False,
) -> DataFrame:
    """One row per key: the row with the greatest ``order_by`` tuple.

    Equal tuples are decided by the source file, if the input has ``SOURCE_FILE``
    (the later poll's name is larger), then by the row's values, so the result
    doesn't depend on how the input is split. ``max`` over a struct runs as partial
    and final aggregation: a hot key is reduced in every map task before the shuffle.

    ``with_counts=True`` keeps the NULL-key group and adds ``_N``, the number of
    input rows per key, so a caller can count processed and rejected rows from
    the reduced result instead of scanning the input again.
    """
    missing = [c for c in order_by if c not in status.columns]
    if missing:
        raise ValueError(f"ordering columns not in the input: {missing}")
    first = [*order_by, *[c for c in ("SOURCE_FILE",) if c in status.columns and c not in order_by]]
    rest = [c for c in status.columns if c != key and c not in first]
    aggs = [F.max(F.struct(*first, *rest)).alias("_latest")]
    if with_counts:
        aggs.append(F.count(F.lit(1)).alias("_N"))
    src = status if with_counts else valid_status(status)
    out = src.groupBy(key).agg(*aggs)
    return out.select(*[F.col(key) if c == key else F.col(f"_latest.{c}") for c in status.columns], *(["_N"] if with_counts else []))


def latest_master(master: DataFrame) -> DataFrame:
    """One row per station of a master that may hold several snapshots (D1): the
    latest by ``TST_REC`` and source file, if there, then the largest row."""
    order = [c for c in ("TST_REC", "SOURCE_FILE") if c in master.columns]
    columns = [c for c in MASTER_COLUMNS + order if c in master.columns]
    return latest_per_station(master.select(*columns), order).select(*MASTER_COLUMNS)


def enrich_status(status: DataFrame, master: DataFrame) -> DataFrame:
    """Status LEFT JOIN master -> the 19 state columns (D1 + B5 + B6 + B4).

    Every status row is kept; a station missing from the master keeps NULL
    name/coordinates/capacity/ratio. ``master`` holds one row per station (see
    :func:`latest_master`). Extra status columns (e.g. an arrival sequence) are
    carried after the state columns. The join strategy is left to the planner and
    AQE, which check the master's size when it runs.
    """
    joined = status.join(master.select(*MASTER_COLUMNS), KEY, "left")
    state_exprs = {
        "OCCUPATION_RATIO": C.occupation_ratio("NUM_BIKES_AVAILABLE", "CAPACITY"),
        "LAST_REPORTED_TST": C.epoch_to_ntz("LAST_REPORTED"),
        "TST_REC": C.ingest_stamp(),
    }
    extra = [c for c in status.columns if c not in STATE_COLUMNS]
    present = set(joined.columns)

    def col(f):
        if f.name in state_exprs:
            return state_exprs[f.name].alias(f.name)
        if f.name in present:
            return F.col(f.name)
        return F.lit(None).cast(f.dataType).alias(f.name)  # field the feed did not carry

    return joined.select(*[col(f) for f in STATE.fields], *[F.col(c) for c in extra])


def current_state(
    status: DataFrame,
    master: DataFrame,
    order_by: Sequence[str] = ("LAST_REPORTED", "TST_REC"),
) -> DataFrame:
    """Latest status per station, enriched: the batch form of the state table.

    The history is reduced first, so the join with the master is station-sized
    on both sides.
    """
    reduced = latest_per_station(status, order_by)
    return enrich_status(reduced.select(*[c for c in reduced.columns if c != "SOURCE_FILE"]), latest_master(master))


def refresh_count(batch: DataFrame) -> DataFrame:
    """'Processed N rows' for one refresh (E1 + B17)."""
    return batch.agg(C.refresh_message(F.count(F.lit(1))).alias("MESSAGE"))
