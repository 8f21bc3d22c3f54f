"""Station-shaped views over the driver's tables (see FIXTURES.md section 3).

``supplier`` plays the station master and ``events`` the status feed. The
arithmetic below is spelled so that DuckDB computes the very same values; the
SQL twins live next to the Spark code so the two can be read side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MASTER, STAGING


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def master_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master table (14 columns) derived from ``supplier``.

    Spelled as one SQL projection: one analysis pass instead of one per column.
    """
    derived = {
        "STATION_ID": "CAST(s_suppkey AS BIGINT)",
        "STATION_NAME": "s_name",
        "ADDRESS": "concat('Street ', CAST(s_suppkey AS STRING))",
        "POST_CODE": "lpad(CAST(s_nationkey AS STRING), 5, '0')",
        "CAPACITY": "CAST(20 + s_suppkey % 31 AS BIGINT)",
        "LAT": "CAST((413500 + (s_suppkey * 37) % 1000) / 1e4 AS DECIMAL(12,7))",
        "LON": "CAST((21000 + (s_suppkey * 91) % 1000) / 1e4 AS DECIMAL(12,7))",
        "TST_REC": "localtimestamp()",
    }
    exprs = [f"{derived.get(f.name, f'CAST(NULL AS {f.dataType.simpleString()})')} AS {f.name}" for f in MASTER.fields]
    return table(spark, sf_dir, "supplier").selectExpr(*exprs)


MASTER_SQL = """
SELECT CAST(s_suppkey AS BIGINT) AS STATION_ID, s_name AS STATION_NAME,
       concat('Street ', CAST(s_suppkey AS VARCHAR)) AS ADDRESS,
       lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS POST_CODE,
       CAST(20 + s_suppkey % 31 AS BIGINT) AS CAPACITY,
       CAST((413500 + (s_suppkey * 37) % 1000) / 1e4 AS DECIMAL(12,7)) AS LAT,
       CAST((21000 + (s_suppkey * 91) % 1000) / 1e4 AS DECIMAL(12,7)) AS LON
FROM supplier
"""


def status_feed(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Staging-shaped status rows (13 columns + EVENT_ID, the arrival order) from ``events``."""
    e = events if events is not None else table(spark, sf_dir, "events")
    return status_from_events(e)


# Cheap columns (key, ordering, category) and the raw payload the typed columns come from.
_RAW_STATUS = [
    "CAST(event_id AS BIGINT) AS EVENT_ID",
    "CAST(user_id AS BIGINT) AS STATION_ID",
    # Epoch seconds of the zone-less timestamp: independent of the session zone.
    "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS LAST_REPORTED",
    "event_type AS STATUS",
    "props AS _PROPS",
    "value AS _VALUE",
]
_TYPED = {
    "NUM_BIKES_AVAILABLE": "try_cast(get_json_object(_PROPS, '$.k') AS BIGINT) % 25",
    "NUM_DOCKS_AVAILABLE": "CAST(floor(_VALUE) AS BIGINT) % 15",
    "TST_REC": "localtimestamp()",
}


def status_raw(e: DataFrame) -> DataFrame:
    """Key, ordering and category of every poll plus the untouched payload.

    Deduplicating on this frame and typing only the survivors parses the JSON
    payload once per station instead of once per poll.
    """
    return e.selectExpr(*_RAW_STATUS)


def status_typed(raw: DataFrame) -> DataFrame:
    """Raw status -> staging columns (13 + EVENT_ID)."""
    exprs = ["EVENT_ID"] + [
        f"{_TYPED[f.name]} AS {f.name}"
        if f.name in _TYPED
        else f.name
        if f.name in ("STATION_ID", "LAST_REPORTED", "STATUS")
        else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
        for f in STAGING.fields
    ]
    return raw.selectExpr(*exprs)


def status_from_events(e: DataFrame) -> DataFrame:
    """Events -> staging columns."""
    return status_typed(status_raw(e))


STATUS_SQL = """
SELECT CAST(event_id AS BIGINT) AS EVENT_ID, CAST(user_id AS BIGINT) AS STATION_ID,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS NUM_BIKES_AVAILABLE,
       CAST(floor(value) AS BIGINT) % 15 AS NUM_DOCKS_AVAILABLE,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS LAST_REPORTED,
       event_type AS STATUS, ts AS TS
FROM events
"""
