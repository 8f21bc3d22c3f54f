"""Query registry: one Spark query per operator key, plus its DuckDB twin.

Every query reads the driver's tables (through the stand-in views) so its
work grows with them. Decimal columns are presented as doubles, the same in
both engines, and non-deterministic load stamps (TST_REC) are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DecimalType, TimestampNTZType, TimestampType

from ..functions import columns as C
from ..operators import balance, docks, geo, metrics, status
from ..session import cut_lineage, scratch_path
from ..sources import readers, sinks
from ..sources.loads import LoadedTable
from ..streaming import staging
from ..streaming.latest import LatestTable, start_latest
from ..streaming.state import StateStore, refresh_state, start_state_refresh
from . import standins as S
from .catalog import create_tables, replace_table
from .sql_functions import register_functions
from .views import register_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Presentation of results, identical in both engines, values unchanged: decimals
# as doubles, timestamps as 'yyyy-MM-dd HH:mm:ss' text, and integer columns that
# a LEFT JOIN can leave NULL as doubles (one nullable numeric type everywhere).
NULLABLE_INTS = ("CAPACITY", "TOTAL_CAPACITY")
TS_FORMAT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FORMAT_SQL = "%Y-%m-%d %H:%M:%S"


def present(df: DataFrame, nullable_ints: tuple[str, ...] = NULLABLE_INTS) -> DataFrame:
    def col(f):
        if isinstance(f.dataType, DecimalType) or f.name in nullable_ints:
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return F.date_format(f.name, TS_FORMAT_SPARK).alias(f.name)
        return F.col(f.name)

    return df.select(*[col(f) for f in df.schema.fields])


# ---------------------------------------------------------------------------------------
# Shared building blocks
# ---------------------------------------------------------------------------------------


def _master(spark: SparkSession, sf: str) -> DataFrame:
    return S.master_stations(spark, sf)


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return S.status_feed(spark, sf)


ORDER = ("LAST_REPORTED", "EVENT_ID")


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """Latest status per station (arrival = EVENT_ID breaks ties), enriched.

    Deduplicated on the raw polls and typed afterwards: the payload is parsed
    for the surviving row of each station only.
    """
    raw = S.status_raw(S.table(spark, sf, "events"))
    latest = S.status_typed(status.latest_per_station(raw, ORDER))
    return status.enrich_status(latest, _master(spark, sf))


STATE_OUT = [
    "STATION_ID",
    "STATION_NAME",
    "LAT",
    "LON",
    "CAPACITY",
    "NUM_BIKES_AVAILABLE",
    "NUM_DOCKS_AVAILABLE",
    "OCCUPATION_RATIO",
    "LAST_REPORTED",
    "LAST_REPORTED_TST",
    "STATUS",
    "EVENT_ID",
]

_STATE_OUT_SQL = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}"
    if c in NULLABLE_INTS
    else f"strftime({c}, '{TS_FORMAT_SQL}') AS {c}"
    if c == "LAST_REPORTED_TST"
    else c
    for c in STATE_OUT
)

# SQL twins of the stand-ins and of the state (ratio by exact integer arithmetic:
# 6 decimals half-up, then 4 decimals half-up).
_WITH = f"""
WITH m AS ({S.MASTER_SQL}),
st AS ({S.STATUS_SQL}),
enriched AS (
  SELECT s.EVENT_ID, s.STATION_ID, m.STATION_NAME, CAST(m.LAT AS DOUBLE) AS LAT, CAST(m.LON AS DOUBLE) AS LON,
         m.CAPACITY, s.NUM_BIKES_AVAILABLE, s.NUM_DOCKS_AVAILABLE,
         CASE WHEN m.CAPACITY <> 0 THEN
           (((2000000 * s.NUM_BIKES_AVAILABLE + m.CAPACITY) // (2 * m.CAPACITY) + 50) // 100) / 1e4 END
           AS OCCUPATION_RATIO,
         s.LAST_REPORTED, make_timestamp(s.LAST_REPORTED * 1000000) AS LAST_REPORTED_TST, s.STATUS
  FROM st s LEFT JOIN m ON s.STATION_ID = m.STATION_ID
),
state AS (
  SELECT * FROM enriched WHERE STATION_ID IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY STATION_ID ORDER BY LAST_REPORTED DESC, EVENT_ID DESC) = 1
)
"""


# ---------------------------------------------------------------------------------------
# Status, state
# ---------------------------------------------------------------------------------------


@query(
    "enrich_status",
    _WITH
    + """
SELECT """
    + _STATE_OUT_SQL
    + """
FROM enriched
""",
)
def q_enrich_status(spark: SparkSession, sf: str) -> DataFrame:
    df = status.enrich_status(_status(spark, sf), _master(spark, sf))
    return present(df.select(*STATE_OUT))


@query("latest_status", _WITH + "SELECT " + _STATE_OUT_SQL + " FROM state")
def q_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return present(_state(spark, sf).select(*STATE_OUT))


@query("refresh_count", _WITH + "SELECT 'Processed ' || CAST(count(*) AS VARCHAR) || ' rows' AS MESSAGE FROM enriched")
def q_refresh_count(spark: SparkSession, sf: str) -> DataFrame:
    return status.refresh_count(status.enrich_status(_status(spark, sf), _master(spark, sf)))


@query(
    "json_fields",
    """
SELECT CAST(event_id AS BIGINT) AS EVENT_ID, json_extract_string(props, '$.k') AS K_TEXT,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS K_NUMBER,
       json_extract_string(props, '$.missing') AS MISSING
FROM events
""",
)
def q_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = S.table(spark, sf, "events")
    return e.select(
        F.col("event_id").cast("bigint").alias("EVENT_ID"),
        C.json_text_field("props", "$.k").alias("K_TEXT"),
        C.to_number(C.json_text_field("props", "$.k")).alias("K_NUMBER"),
        C.json_text_field("props", "$.missing").alias("MISSING"),
    )


@query(
    "decimal_coords",
    f"""
WITH m AS ({S.MASTER_SQL})
SELECT STATION_ID, CAST(CAST(CAST(LAT AS VARCHAR) AS DECIMAL(12,7)) AS VARCHAR) AS LAT_TEXT,
       CAST(CAST(CAST(LON AS VARCHAR) AS DECIMAL(12,7)) AS VARCHAR) AS LON_TEXT
FROM m
""",
)
def q_decimal_coords(spark: SparkSession, sf: str) -> DataFrame:
    m = _master(spark, sf)
    return m.select(
        "STATION_ID",
        C.to_fixed(F.col("LAT").cast("string")).cast("string").alias("LAT_TEXT"),
        C.to_fixed(F.col("LON").cast("string")).cast("string").alias("LON_TEXT"),
    )


# ---------------------------------------------------------------------------------------
# Broken docks
# ---------------------------------------------------------------------------------------

_BROKEN_SQL = """
broken AS (
  SELECT m.STATION_ID, m.STATION_NAME, m.ADDRESS, CAST(m.LAT AS DOUBLE) AS LAT, CAST(m.LON AS DOUBLE) AS LON,
         m.CAPACITY - (c.NUM_BIKES_AVAILABLE + c.NUM_DOCKS_AVAILABLE) AS BROKEN_DOCKS
  FROM m LEFT JOIN state c ON m.STATION_ID = c.STATION_ID
  WHERE c.NUM_BIKES_AVAILABLE + c.NUM_DOCKS_AVAILABLE < m.CAPACITY
)
"""


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    return docks.broken_docks(_master(spark, sf), _state(spark, sf))


@query("broken_docks", _WITH + "," + _BROKEN_SQL + "SELECT * FROM broken")
def q_broken_docks(spark: SparkSession, sf: str) -> DataFrame:
    return present(_broken(spark, sf))


@query(
    "top_broken_docks",
    _WITH
    + ","
    + _BROKEN_SQL
    + "SELECT * FROM broken WHERE BROKEN_DOCKS > 1 ORDER BY BROKEN_DOCKS DESC, STATION_ID ASC LIMIT 10",
)
def q_top_broken_docks(spark: SparkSession, sf: str) -> DataFrame:
    return present(docks.top_broken_docks(_broken(spark, sf)))


@query(
    "broken_docks_list",
    _WITH
    + ","
    + _BROKEN_SQL
    + """
SELECT STATION_NAME, BROKEN_DOCKS FROM (
  SELECT * FROM broken WHERE BROKEN_DOCKS > 1 ORDER BY BROKEN_DOCKS DESC, STATION_ID ASC LIMIT 10)
""",
)
def q_broken_docks_list(spark: SparkSession, sf: str) -> DataFrame:
    return docks.broken_docks_list(docks.top_broken_docks(_broken(spark, sf)))


# ---------------------------------------------------------------------------------------
# Column library over the state
# ---------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return balance.station_features(_state(spark, sf))


@query(
    "station_features",
    _WITH
    + """
SELECT STATION_ID, STATION_NAME, LAT, LON, CAST(CAPACITY AS DOUBLE) AS CAPACITY, NUM_BIKES_AVAILABLE,
       NUM_DOCKS_AVAILABLE, OCCUPATION_RATIO, CAST(CAPACITY AS DOUBLE) AS TOTAL_CAPACITY, OCCUPATION_RATIO AS RATIO,
       'Station ID: ' || coalesce(STATION_NAME, 'None') || ' - Bikes Available: '
         || coalesce(CAST(NUM_BIKES_AVAILABLE AS VARCHAR), 'None') AS LABEL
FROM state
""",
)
def q_station_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return present(f.withColumn("LABEL", C.station_label("STATION_NAME", "NUM_BIKES_AVAILABLE")))


_COLOR_SQL = """
CASE WHEN r IS NULL OR isnan(r) THEN NULL
     WHEN r >= 0.4e0 AND r <= 0.6e0 THEN '#00FF00'
     WHEN r < 0.4e0 THEN printf('#%02x%02x%02x', 0,
        least(greatest(CAST(trunc(255e0 * r / 0.4e0) AS INTEGER), 0), 255),
        least(greatest(CAST(trunc(255e0 * (0.4e0 - r) / 0.4e0) AS INTEGER), 0), 255))
     ELSE printf('#%02x%02x%02x',
        least(greatest(CAST(trunc(255e0 * (r - 0.6e0) / 0.4e0) AS INTEGER), 0), 255),
        least(greatest(CAST(trunc(255e0 * (1e0 - (r - 0.6e0) / 0.4e0)) AS INTEGER), 0), 255), 0)
END"""


@query(
    "occupancy_color",
    _WITH
    + f"""
SELECT STATION_ID, r AS RATIO, {_COLOR_SQL} AS COLOR
FROM (SELECT STATION_ID, OCCUPATION_RATIO AS r FROM state)
""",
)
def q_occupancy_color(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return f.select("STATION_ID", "RATIO", C.occupancy_color("RATIO").alias("COLOR"))


_ENTROPY_SQL = """
CASE WHEN r = 0 OR r = 1 THEN 0e0
     WHEN r > 0 AND r < 1 THEN -r * log2(r) - (1e0 - r) * log2(1e0 - r) END"""


@query(
    "station_entropy",
    _WITH
    + f"""
SELECT STATION_ID, round({_ENTROPY_SQL}, 12) AS ENTROPY
FROM (SELECT STATION_ID, OCCUPATION_RATIO AS r FROM state)
""",
)
def q_station_entropy(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return f.select("STATION_ID", F.round(C.binary_entropy("RATIO"), 12).alias("ENTROPY"))


@query(
    "bike_need",
    _WITH
    + """
SELECT STATION_ID, round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED,
       round_even(CAPACITY * 0.5e0 - NUM_BIKES_AVAILABLE, 0) AS NEED_VISITED
FROM state
""",
)
def q_bike_need(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return f.select(
        "STATION_ID",
        C.bike_need("TOTAL_CAPACITY", "NUM_BIKES_AVAILABLE").alias("NEED"),
        C.bike_need("TOTAL_CAPACITY", "NUM_BIKES_AVAILABLE", C.VISITED_TARGET).alias("NEED_VISITED"),
    )


@query(
    "transfer_amounts",
    _WITH
    + """
SELECT STATION_ID,
       least(least(20e0, abs(NEED)), CAST(NUM_BIKES_AVAILABLE AS DOUBLE)) AS PICKUP_EMPTY_TRUCK,
       least(least(10e0, abs(NEED)), CAST(NUM_BIKES_AVAILABLE AS DOUBLE)) AS PICKUP_HALF_TRUCK,
       round_even(least(20e0, NEED, CAST(NUM_DOCKS_AVAILABLE AS DOUBLE)) / 1.7e0, 0) AS DROPOFF_FULL_TRUCK,
       round_even(least(10e0, NEED, CAST(NUM_DOCKS_AVAILABLE AS DOUBLE)) / 1.7e0, 0) AS DROPOFF_HALF_TRUCK
FROM (SELECT *, round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED FROM state)
""",
)
def q_transfer_amounts(spark: SparkSession, sf: str) -> DataFrame:
    f = balance.with_need(_features(spark, sf))
    return f.select(
        "STATION_ID",
        C.pickup_amount(F.lit(20), "NEED", "NUM_BIKES_AVAILABLE").alias("PICKUP_EMPTY_TRUCK"),
        C.pickup_amount(F.lit(10), "NEED", "NUM_BIKES_AVAILABLE").alias("PICKUP_HALF_TRUCK"),
        C.dropoff_amount(F.lit(20), "NEED", "NUM_DOCKS_AVAILABLE").alias("DROPOFF_FULL_TRUCK"),
        C.dropoff_amount(F.lit(10), "NEED", "NUM_DOCKS_AVAILABLE").alias("DROPOFF_HALF_TRUCK"),
    )


@query(
    "rebalance_candidates",
    _WITH
    + """
SELECT STATION_ID, OCCUPATION_RATIO AS RATIO, NEED, NEED < 0 AS IS_SURPLUS
FROM (SELECT *, round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED FROM state)
WHERE OCCUPATION_RATIO > 0e0 OR OCCUPATION_RATIO < 0.1e0
""",
)
def q_rebalance_candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = balance.rebalance_candidates(balance.with_need(_features(spark, sf)))
    return f.select("STATION_ID", "RATIO", "NEED", (F.col("NEED") < 0).alias("IS_SURPLUS"))


@query(
    "surplus_stations",
    _WITH
    + """
SELECT STATION_ID, NEED
FROM (SELECT *, round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED FROM state)
WHERE (OCCUPATION_RATIO > 0e0 OR OCCUPATION_RATIO < 0.1e0) AND NEED < 0
""",
)
def q_surplus_stations(spark: SparkSession, sf: str) -> DataFrame:
    f = balance.surplus_stations(balance.rebalance_candidates(balance.with_need(_features(spark, sf))))
    return f.select("STATION_ID", "NEED")


@query(
    "invalid_ratio",
    _WITH
    + """
SELECT STATION_ID, NUM_BIKES_AVAILABLE, CAPACITY AS TOTAL_CAPACITY,
       CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / CAST(CAPACITY AS DOUBLE) AS VISITED_RATIO
FROM state
WHERE CAPACITY <> 0 AND (CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / CAST(CAPACITY AS DOUBLE) < 0
   OR CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / CAST(CAPACITY AS DOUBLE) > 1)
""",
)
def q_invalid_ratio(spark: SparkSession, sf: str) -> DataFrame:
    f = balance.invalid_ratio(_features(spark, sf))
    return f.select("STATION_ID", "NUM_BIKES_AVAILABLE", "TOTAL_CAPACITY", "VISITED_RATIO")


# ---------------------------------------------------------------------------------------
# Metrics (E2, E3)
# ---------------------------------------------------------------------------------------


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds and counts read the features twice: stored, the history is reduced once."""
    return cut_lineage(_features(spark, sf), "features")


def _hist_sql(src: str, bins: int = 40) -> str:
    """numpy-style equal-width histogram in SQL: guess, then correct against the edges."""
    return f"""
b AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5e0 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5e0 ELSE max(x) END AS hi
      FROM {src} WHERE x IS NOT NULL),
g AS (SELECT x, lo, hi, (hi - lo) / {bins}e0 AS step,
             least(CAST(trunc((x - lo) / (hi - lo) * {bins}e0) AS INTEGER), {bins - 1}) AS i0
      FROM {src}, b WHERE x IS NOT NULL),
g1 AS (SELECT *, CASE WHEN x < i0 * step + lo THEN i0 - 1 ELSE i0 END AS i1 FROM g),
g2 AS (SELECT CASE WHEN x >= (CASE WHEN i1 + 1 = {bins} THEN hi ELSE (i1 + 1) * step + lo END)
                    AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS BIN FROM g1),
c AS (SELECT BIN, count(*) AS n FROM g2 GROUP BY BIN),
allb AS (SELECT CAST(range AS INTEGER) AS BIN FROM range({bins}))
SELECT allb.BIN AS BIN, allb.BIN * ((hi - lo) / {bins}e0) + lo AS BIN_LO,
       CASE WHEN allb.BIN + 1 = {bins} THEN hi ELSE (allb.BIN + 1) * ((hi - lo) / {bins}e0) + lo END AS BIN_HI,
       coalesce(c.n, 0) AS COUNT
FROM allb LEFT JOIN c ON allb.BIN = c.BIN, b
"""


@query(
    "ratio_histogram",
    _WITH + ", xs AS (SELECT OCCUPATION_RATIO AS x FROM state), " + _hist_sql("xs"),
)
def q_ratio_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ratio_histogram(_stored_features(spark, sf), "RATIO", 40)


@query(
    "visited_ratio_histogram",
    _WITH
    + """, xs AS (SELECT CASE WHEN CAPACITY <> 0 THEN
            CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / CAST(CAPACITY AS DOUBLE) END AS x FROM state), """
    + _hist_sql("xs"),
)
def q_visited_ratio_histogram(spark: SparkSession, sf: str) -> DataFrame:
    f = _stored_features(spark, sf)
    return metrics.ratio_histogram(f, C.visited_ratio("NUM_BIKES_AVAILABLE", "TOTAL_CAPACITY"), 40)


# ---------------------------------------------------------------------------------------
# Geography
# ---------------------------------------------------------------------------------------

# Query parameters: pair radius in metres, degree radius, grid cell of the area means.
PAIR_RADIUS_M = 1500.0
DEGREE_RADIUS = 0.01
AREA_CELL_DEG = 0.01

_POINTS_SQL = f"""
WITH m AS ({S.MASTER_SQL}),
p AS (SELECT STATION_ID AS id, CAST(LAT AS DOUBLE) AS lat, CAST(LON AS DOUBLE) AS lon FROM m)
"""

_HAVERSINE_SQL = f"""
2e0 * {C.EARTH_RADIUS_M}e0 * asin(sqrt(
  sin((radians(b.lat) - radians(a.lat)) / 2e0) * sin((radians(b.lat) - radians(a.lat)) / 2e0)
  + cos(radians(a.lat)) * cos(radians(b.lat))
    * sin((radians(b.lon) - radians(a.lon)) / 2e0) * sin((radians(b.lon) - radians(a.lon)) / 2e0)))"""

_PAIRS_SQL = (
    _POINTS_SQL
    + f"""
SELECT SRC_STATION_ID, TGT_STATION_ID, round(DISTANCE, 3) AS DISTANCE FROM (
  SELECT a.id AS SRC_STATION_ID, b.id AS TGT_STATION_ID, {_HAVERSINE_SQL} AS DISTANCE
  FROM p a JOIN p b ON a.id < b.id)
WHERE DISTANCE <= {PAIR_RADIUS_M}e0
"""
)


# Every pair, as the reference's view has them.
_ALL_PAIRS_SQL = (
    _POINTS_SQL
    + f"""
SELECT a.id AS SRC_STATION_ID, b.id AS TGT_STATION_ID, round({_HAVERSINE_SQL}, 3) AS DISTANCE
FROM p a JOIN p b ON a.id < b.id
"""
)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return geo.pairs_within(_master(spark, sf), PAIR_RADIUS_M)


def _rounded_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("DISTANCE", F.round("DISTANCE", 3))


@query("station_pairs", _ALL_PAIRS_SQL)
def q_station_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The distance of every station pair (D3)."""
    return _rounded_pairs(geo.all_pairs(_master(spark, sf)))


@query("pairs_upkeep", _PAIRS_SQL)
def q_pairs_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """The pair table of an earlier master brought up to date: some stations are new, some have moved, some are gone."""
    after = _master(spark, sf).select("STATION_ID", "LAT", "LON")
    key = F.col("STATION_ID")
    lat = F.when(key % 89 == 0, F.col("LAT") + F.lit(0.01)).otherwise(F.col("LAT")).cast("decimal(12,7)")
    gone = after.where(key % 83 == 0).withColumn("STATION_ID", key + 10**9)
    before = after.where(key % 97 != 0).withColumn("LAT", lat).unionByName(gone)
    pairs = sinks.materialise(geo.pairs_within(before, PAIR_RADIUS_M), scratch_path(spark, "pairs-before"))
    return _rounded_pairs(geo.update_pairs(pairs, before, after, PAIR_RADIUS_M))


@query("sql_station_pairs", _PAIRS_SQL)
def q_sql_station_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs by a table function of SQL text, with the radius as its parameter."""
    prefix = f"q{uuid.uuid4().hex[:8]}_"
    _master(spark, sf).createOrReplaceTempView(f"{prefix}stations")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {prefix}broken_docks AS SELECT 0L AS STATION_ID, '' AS STATION_NAME, 0L AS BROKEN_DOCKS WHERE false")
    register_functions(spark, prefix)
    return _rounded_pairs(spark.sql(f"SELECT SRC_STATION_ID, TGT_STATION_ID, DISTANCE FROM {prefix}station_pairs_within({PAIR_RADIUS_M}e0)"))


@query("materialised_pairs", _PAIRS_SQL)
def q_materialised_pairs(spark: SparkSession, sf: str) -> DataFrame:
    stored = sinks.materialise(_pairs(spark, sf), scratch_path(spark, "pairs"))
    return stored.withColumn("DISTANCE", F.round("DISTANCE", 3))


@query(
    "degree_pairs",
    _POINTS_SQL
    + f"""
SELECT SRC_STATION_ID, TGT_STATION_ID, DISTANCE FROM (
  SELECT a.id AS SRC_STATION_ID, b.id AS TGT_STATION_ID,
         sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) AS DISTANCE
  FROM p a JOIN p b ON a.id <> b.id)
WHERE DISTANCE <= {DEGREE_RADIUS}e0
""",
)
def q_degree_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return geo.degree_pairs_within(_master(spark, sf), DEGREE_RADIUS)


@query(
    "nearest_station",
    _POINTS_SQL
    + """
SELECT a.id AS STATION_ID, b.id AS NEAREST_ID,
       sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) AS DISTANCE
FROM p a JOIN p b ON a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY DISTANCE, b.id) = 1
""",
)
def q_nearest_station(spark: SparkSession, sf: str) -> DataFrame:
    return geo.nearest_station(_master(spark, sf))


@query(
    "area_mean_ratio",
    _WITH
    + f"""
, cells AS (
  SELECT CAST(floor(LAT / {AREA_CELL_DEG}e0) AS BIGINT) AS CELL_LAT, CAST(floor(LON / {AREA_CELL_DEG}e0) AS BIGINT) AS CELL_LON,
         count(w) AS N_STATIONS, coalesce(avg(w), 0e0) AS r
  FROM (SELECT LAT, LON,
          (CASE WHEN CAPACITY <> 0 THEN CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / CAST(CAPACITY AS DOUBLE) END + 2e0) - 2e0 AS w
        FROM state WHERE LAT IS NOT NULL AND LON IS NOT NULL)
  GROUP BY 1, 2)
SELECT CELL_LAT, CELL_LON, N_STATIONS, round(r, 9) AS MEAN_RATIO, {_COLOR_SQL} AS COLOR FROM cells
""",
)
def q_area_mean_ratio(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).where(F.col("LAT").isNotNull() & F.col("LON").isNotNull())
    f = f.withColumn("VISITED_RATIO", C.visited_ratio("NUM_BIKES_AVAILABLE", "TOTAL_CAPACITY"))
    out = geo.area_mean_ratio(f, AREA_CELL_DEG, "VISITED_RATIO")
    return out.withColumn("MEAN_RATIO", F.round("MEAN_RATIO", 9))


# ---------------------------------------------------------------------------------------
# Rebalancing plan
# ---------------------------------------------------------------------------------------

# The walk in SQL: from the start always the nearest candidate of the zone that is not
# yet seen, then the amounts as a second recursion over the ordered stops.
_PLAN_SQL = (
    _WITH.replace("WITH m AS", "WITH RECURSIVE m AS")
    + """
, features AS (
  SELECT s.*, CAST(CAPACITY AS DOUBLE) AS cap, coalesce(m2.POST_CODE, '') AS ZONE,
         round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED
  FROM state s LEFT JOIN (SELECT STATION_ID AS id2, POST_CODE FROM m) m2 ON s.STATION_ID = m2.id2),
cand AS (SELECT * FROM features WHERE OCCUPATION_RATIO > 0e0 OR OCCUPATION_RATIO < 0.1e0),
walk AS (
  SELECT ZONE, 1 AS stop, STATION_ID AS id, LAT, LON, [STATION_ID] AS seen FROM (
    SELECT *, row_number() OVER (PARTITION BY ZONE ORDER BY least(NEED, 0e0), STATION_ID) AS rn FROM cand) WHERE rn = 1
  UNION ALL
  SELECT ZONE, stop, id, LAT, LON, seen FROM (
    SELECT w.ZONE, w.stop + 1 AS stop, c.STATION_ID AS id, c.LAT, c.LON, list_append(w.seen, c.STATION_ID) AS seen,
           row_number() OVER (PARTITION BY w.ZONE ORDER BY
             sqrt((c.LAT - w.LAT) * (c.LAT - w.LAT) + (c.LON - w.LON) * (c.LON - w.LON)) NULLS LAST, c.STATION_ID) AS rn
    FROM walk w JOIN cand c ON c.ZONE = w.ZONE AND NOT list_contains(w.seen, c.STATION_ID)) WHERE rn = 1),
stops AS (
  SELECT w.ZONE, w.stop, w.id, lead(w.id) OVER (PARTITION BY w.ZONE ORDER BY w.stop) AS next_id,
         c.NEED AS need, c.cap, CAST(c.NUM_BIKES_AVAILABLE AS DOUBLE) AS bikes, CAST(c.NUM_DOCKS_AVAILABLE AS DOUBLE) AS docks
  FROM walk w JOIN cand c ON c.STATION_ID = w.id),
visits AS (
  SELECT ZONE, 0 AS stop, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS next_id, 0e0 AS amount, false AS pick, 0e0 AS load,
         0e0 AS bikes, 0e0 AS docks, 0e0 AS cap
  FROM stops WHERE stop = 1
  UNION ALL
  SELECT ZONE, stop, id, next_id, amount, pick, load + CASE WHEN pick THEN amount ELSE -amount END,
         bikes - CASE WHEN pick THEN amount ELSE -amount END, docks + CASE WHEN pick THEN amount ELSE -amount END, cap
  FROM (
    SELECT s.ZONE, s.stop, s.id, s.next_id, s.need < 0 AS pick, v.load, s.bikes, s.docks, s.cap,
           CASE WHEN s.need < 0 THEN least(least(20e0 - v.load, abs(s.need)), s.bikes)
                ELSE round_even(least(v.load, s.need, s.docks) / 1.7e0, 0) END AS amount
    FROM visits v JOIN stops s ON s.ZONE = v.ZONE AND s.stop = v.stop + 1 AND s.next_id IS NOT NULL)),
legs AS (
  SELECT ZONE, CAST(stop AS INTEGER) AS LEG_NO, id AS FROM_ID, next_id AS TO_ID, CAST(amount AS INTEGER) AS AMOUNT,
         CASE WHEN pick THEN 'Picked up ' ELSE 'Dropped off ' END || CAST(CAST(amount AS INTEGER) AS VARCHAR) || ' bikes' AS ACTION,
         CAST(load AS BIGINT) AS LOAD_AFTER, CAST(bikes AS BIGINT) AS BIKES_AFTER, CAST(docks AS BIGINT) AS DOCKS_AFTER,
         bikes / cap AS RATIO_AFTER, round_even(cap * 0.5e0 - bikes, 0) AS NEED_AFTER
  FROM visits WHERE stop > 0),
texts AS (SELECT *, 'Bus ' || ACTION || ', then moved from Station ' || FROM_ID || ' to Station ' || TO_ID || '.' AS TEXT FROM legs),
applied AS (
  SELECT f.STATION_ID, f.ZONE, f.cap, f.OCCUPATION_RATIO AS INITIAL_RATIO,
         CAST(coalesce(l.BIKES_AFTER, f.NUM_BIKES_AVAILABLE) AS BIGINT) AS NUM_BIKES_AVAILABLE,
         CAST(CASE WHEN l.FROM_ID IS NULL THEN f.NUM_DOCKS_AVAILABLE ELSE l.DOCKS_AFTER END AS BIGINT) AS NUM_DOCKS_AVAILABLE,
         CASE WHEN l.FROM_ID IS NULL THEN f.OCCUPATION_RATIO ELSE l.RATIO_AFTER END AS RATIO,
         CASE WHEN l.FROM_ID IS NULL THEN f.NEED ELSE l.NEED_AFTER END AS NEED
  FROM features f LEFT JOIN legs l ON l.FROM_ID = f.STATION_ID)
"""
)


def _routes(features: DataFrame) -> DataFrame:
    return balance.plan_routes(features, "POST_CODE", start="max_surplus")


_AFTER_SQL = "CASE WHEN cap <> 0 THEN CAST(NUM_BIKES_AVAILABLE AS DOUBLE) / cap END"


def _planner_input(spark: SparkSession, sf: str) -> DataFrame:
    """Planner features with their zone: stored once as a station-sized table, so that
    the status history is reduced once however often the plan reads it."""
    zones = _master(spark, sf).select("STATION_ID", "POST_CODE")
    features = balance.station_features(_state(spark, sf)).join(zones, "STATION_ID", "left")
    return cut_lineage(features, "features")


def _plan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(features, legs) from the largest surplus of each zone; the walk is stored once."""
    f = _planner_input(spark, sf)
    return f, cut_lineage(_routes(f), "legs")


@query("plan_routes", _PLAN_SQL + "SELECT * FROM legs")
def q_plan_routes(spark: SparkSession, sf: str) -> DataFrame:
    return _routes(_planner_input(spark, sf))


_APPLIED_OUT = ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE", "INITIAL_RATIO", "RATIO", "NEED"]


@query("apply_plan", _PLAN_SQL + "SELECT " + ", ".join(_APPLIED_OUT) + " FROM applied")
def q_apply_plan(spark: SparkSession, sf: str) -> DataFrame:
    return balance.apply_plan(*_plan(spark, sf)).select(*_APPLIED_OUT)


@query(
    "route_legs",
    _PLAN_SQL
    + """
SELECT t.ZONE, LEG_NO, FROM_ID, TO_ID, AMOUNT, ACTION, CAST(a.LAT AS DOUBLE) AS FROM_LAT, CAST(a.LON AS DOUBLE) AS FROM_LON,
       CAST(b.LAT AS DOUBLE) AS TO_LAT, CAST(b.LON AS DOUBLE) AS TO_LON, TEXT
FROM texts t LEFT JOIN m a ON a.STATION_ID = FROM_ID LEFT JOIN m b ON b.STATION_ID = TO_ID
""",
)
def q_route_legs(spark: SparkSession, sf: str) -> DataFrame:
    return balance.route_legs(_plan(spark, sf)[1], _master(spark, sf))


@query(
    "route_text",
    _PLAN_SQL
    + f"""
SELECT ZONE, '{balance.PLAN_HEADER}' || chr(10) || string_agg(TEXT || chr(10), '' ORDER BY LEG_NO) AS TEXT FROM texts GROUP BY ZONE
""",
)
def q_route_text(spark: SparkSession, sf: str) -> DataFrame:
    return balance.route_text(_plan(spark, sf)[1])


@query(
    "plan_entropy_report",
    _PLAN_SQL
    + f"""
, e AS (
  SELECT sum(CASE WHEN v = 0 THEN ent END) AS b, sum(CASE WHEN v = 1 THEN ent END) AS a
  FROM (SELECT v, {_ENTROPY_SQL} AS ent
        FROM (SELECT 0 AS v, INITIAL_RATIO AS r FROM applied UNION ALL SELECT 1 AS v, {_AFTER_SQL} AS r FROM applied)))
SELECT round(coalesce(b, 0), 4) AS INITIAL_ENTROPY, round(coalesce(a, 0), 4) AS FINAL_ENTROPY,
       round(coalesce(a, 0) - coalesce(b, 0), 4) AS ENTROPY_GAIN
FROM e
""",
)
def q_plan_entropy_report(spark: SparkSession, sf: str) -> DataFrame:
    return balance.plan_metrics(balance.apply_plan(*_plan(spark, sf)))[0]


@query(
    "plan_histograms",
    _PLAN_SQL
    + ", before AS (SELECT INITIAL_RATIO AS x FROM applied), after AS (SELECT "
    + _AFTER_SQL
    + " AS x FROM applied), hist_before AS (WITH "
    + _hist_sql("before")
    + "), hist_after AS (WITH "
    + _hist_sql("after")
    + ") SELECT 'before' AS PLAN, * FROM hist_before UNION ALL SELECT 'after' AS PLAN, * FROM hist_after",
)
def q_plan_histograms(spark: SparkSession, sf: str) -> DataFrame:
    _, before, after = balance.plan_metrics(balance.apply_plan(*_plan(spark, sf)))
    return before.withColumn("PLAN", F.lit("before")).unionByName(after.withColumn("PLAN", F.lit("after")))


# ---------------------------------------------------------------------------------------
# Incremental state
# ---------------------------------------------------------------------------------------

# The two arrival batches of the upsert keys: clicks and views land first, the
# other event types later (so later arrivals can carry older LAST_REPORTED).
FIRST_BATCH_TYPES = ("click", "view")

_TWO_BATCH_SQL = (
    _WITH
    + """
, first_batch AS (
  SELECT * FROM enriched WHERE STATUS IN ('click', 'view') AND STATION_ID IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY STATION_ID ORDER BY LAST_REPORTED DESC, EVENT_ID DESC) = 1),
second_batch AS (
  SELECT * FROM enriched WHERE (STATUS NOT IN ('click', 'view') OR STATUS IS NULL) AND STATION_ID IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY STATION_ID ORDER BY LAST_REPORTED DESC, EVENT_ID DESC) = 1),
merged AS (
  SELECT * FROM second_batch
  UNION ALL
  SELECT * FROM first_batch WHERE STATION_ID NOT IN (SELECT STATION_ID FROM second_batch))
"""
)


def _two_batches(spark: SparkSession, sf: str) -> tuple[StateStore, DataFrame, DataFrame]:
    st = _status(spark, sf)
    first = st.where(F.col("STATUS").isin(*FIRST_BATCH_TYPES))
    second = st.where(~F.col("STATUS").isin(*FIRST_BATCH_TYPES) | F.col("STATUS").isNull())
    return StateStore(spark, scratch_path(spark, "state")), first, second


def _run_two_batches(spark: SparkSession, sf: str, order: str = "arrival") -> StateStore:
    store, first, second = _two_batches(spark, sf)
    for batch_id, batch in enumerate((first, second)):
        refresh_state(batch, batch_id, store, _master(spark, sf), order_by=ORDER, order=order)
    return store


@query("upsert_two_batches", _TWO_BATCH_SQL + "SELECT " + _STATE_OUT_SQL + " FROM merged")
def q_upsert_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    store = _run_two_batches(spark, sf)
    return present(store.read().select(*STATE_OUT))


@query(
    "entropy_report",
    _TWO_BATCH_SQL
    + f"""
, e AS (
  SELECT sum(CASE WHEN v = 0 THEN ent END) AS b, sum(CASE WHEN v = 1 THEN ent END) AS a
  FROM (SELECT v, {_ENTROPY_SQL} AS ent
        FROM (SELECT 0 AS v, OCCUPATION_RATIO AS r FROM first_batch
              UNION ALL SELECT 1 AS v, OCCUPATION_RATIO AS r FROM merged)))
SELECT round(coalesce(b, 0), 4) AS INITIAL_ENTROPY, round(coalesce(a, 0), 4) AS FINAL_ENTROPY,
       round(coalesce(a, 0) - coalesce(b, 0), 4) AS ENTROPY_GAIN
FROM e
""",
)
def q_entropy_report(spark: SparkSession, sf: str) -> DataFrame:
    store = _run_two_batches(spark, sf)
    before, after = store.read(version=0), store.read(version=1)
    return metrics.entropy_report_versions(before, after, "OCCUPATION_RATIO")


@query("stream_latest_status", _WITH + "SELECT " + _STATE_OUT_SQL + " FROM state")
def q_stream_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    events_path = f"{sf.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(events_path).schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = scratch_path(spark, "stream-state")
    _ended(start_state_refresh(S.status_from_events(src), _master(spark, sf), f"{root}/state", f"{root}/checkpoint", available_now=True, order_by=ORDER))
    return present(StateStore(spark, f"{root}/state").read().select(*STATE_OUT))


_FEED_COLS = ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE", "LAST_REPORTED", "STATUS"]
_FEED_SQL = f"WITH st AS ({S.STATUS_SQL}) SELECT " + ", ".join(_FEED_COLS) + " FROM st"


# The landed snapshots of a stream: event types in two parts, every poll of them. Each seventh poll has
# no id. A feed object doesn't say when it arrived, so polls of one report time are told apart by their values.
_FEED_STATE = ["STATION_ID", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE", "LAST_REPORTED", "STATUS", "STATION_NAME", "CAPACITY"]
FEED_ORDER = ("LAST_REPORTED",)


def _landed(spark: SparkSession, sf: str) -> list[DataFrame]:
    feed = _status(spark, sf).withColumn("STATION_ID", F.when(F.col("EVENT_ID") % 7 != 0, F.col("STATION_ID")))
    first = F.coalesce(F.col("STATUS").isin(*FIRST_BATCH_TYPES), F.lit(False))
    return [feed.where(first), feed.where(~first)]


def _feed_state_sql(where: str = "true") -> str:
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in NULLABLE_INTS else c for c in _FEED_STATE)
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("LAST_REPORTED", "NUM_BIKES_AVAILABLE", "NUM_DOCKS_AVAILABLE", "STATUS"))
    return (
        _WITH
        + f"SELECT {columns} FROM enriched WHERE STATION_ID IS NOT NULL AND EVENT_ID % 7 <> 0 AND {where} "
        + f"QUALIFY row_number() OVER (PARTITION BY STATION_ID ORDER BY {order}) = 1"
    )


def _ended(q: StreamingQuery) -> StreamingQuery:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def _land(part: DataFrame, root: str, number: int) -> None:
    sinks.write_snapshot_json(sinks.to_feed_shape(part), f"{root}/landing", f"20240101_00{number:02d}00")


def _refreshed(spark: SparkSession, sf: str, source: DataFrame, root: str, start: str = "first") -> None:
    _ended(
        start_state_refresh(
            source, lambda: _master(spark, sf), f"{root}/state", f"{root}/checkpoint", available_now=True, order_by=FEED_ORDER, order="event_time", start=start
        )
    )


def _feed_state(spark: SparkSession, root: str) -> DataFrame:
    return present(StateStore(spark, f"{root}/state").read().select(*_FEED_STATE))


def _snapshots(spark: SparkSession, root: str) -> DataFrame:
    return readers.stream_status_json(spark, f"{root}/landing", "stations*", max_files_per_trigger=4, with_source_file=False)


@query("stream_json_snapshots", _feed_state_sql())
def q_stream_json_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """JSON snapshots through the streaming reader, a few files a micro-batch."""
    root = scratch_path(spark, "json-stream")
    for i, part in enumerate(_landed(spark, sf)):
        _land(part, root, i)
    _refreshed(spark, sf, _snapshots(spark, root), root)
    return _feed_state(spark, root)


@query("stream_restart", _feed_state_sql())
def q_stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The same, stopped after the first snapshot and started again on its checkpoint (A4)."""
    root = scratch_path(spark, "json-stream")
    for i, part in enumerate(_landed(spark, sf)):
        _land(part, root, i)
        _refreshed(spark, sf, _snapshots(spark, root), root)
    return _feed_state(spark, root)


@query("stream_from_now", _feed_state_sql("(STATUS NOT IN ('click', 'view') OR STATUS IS NULL)"))
def q_stream_from_now(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that starts from now: what lay there at its creation never reaches the state."""
    root = scratch_path(spark, "json-stream")
    first, second = _landed(spark, sf)
    _land(first, root, 0)
    _refreshed(spark, sf, _snapshots(spark, root), root, start="now")
    _land(second, root, 1)
    _refreshed(spark, sf, _snapshots(spark, root), root, start="now")
    return _feed_state(spark, root)


@query("stream_two_hops", _feed_state_sql())
def q_stream_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Feed -> append-only staging table -> stream over that table -> state; both hops stop after each snapshot (A5, G1)."""
    root = scratch_path(spark, "two-hops")
    for i, part in enumerate(_landed(spark, sf)):
        _land(part, root, i)
        feed = readers.stream_status_json(spark, f"{root}/landing", "stations*")
        _ended(staging.start_staging(feed, f"{root}/staging", f"{root}/hop1", available_now=True))
        _refreshed(spark, sf, staging.stream_staging(spark, f"{root}/staging", 4).drop("SOURCE_FILE"), root)
    return _feed_state(spark, root)


@query("landing_expired", _FEED_SQL)
def q_landing_expired(spark: SparkSession, sf: str) -> DataFrame:
    """A landing folder whose consumed files the stream archives: archive and folder hold every poll once."""
    root = scratch_path(spark, "expiry")
    _, first, second = _two_batches(spark, sf)
    cleaner = "spark.sql.streaming.fileSource.cleaner.numThreads"
    before = spark.conf.get(cleaner, None)
    spark.conf.set(cleaner, "0")  # files move between batches, not beside what reads them here
    try:
        for i, part in enumerate((first, second)):
            _land(part, root, i)
            source = readers.stream_status_json(spark, f"{root}/landing", "stations*", max_files_per_trigger=8, clean_source="archive", archive_dir=f"{root}/archive", with_source_file=False)
            _refreshed(spark, sf, source, root)
    finally:
        if before is None:
            spark.conf.unset(cleaner)
        else:
            spark.conf.set(cleaner, before)
    archived = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/landing").toUri().getPath()
    both = [readers.read_status_json(spark, path) for path in (f"{root}/archive{archived}", f"{root}/landing")]
    return both[0].unionByName(both[1]).select(*_FEED_COLS)


@query(
    "feed_metrics",
    f"WITH st AS ({S.STATUS_SQL}) SELECT count(*) AS PROCESSED, count(*) FILTER (STATION_ID IS NULL OR EVENT_ID % 7 = 0) AS REJECTED, "
    "count(*) FILTER (NUM_BIKES_AVAILABLE IS NULL OR NUM_DOCKS_AVAILABLE IS NULL OR NUM_BIKES_AVAILABLE < 0 OR NUM_DOCKS_AVAILABLE < 0) AS INVALID FROM st",
)
def q_feed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a feed, observed while the first hop appends it: no job of their own."""
    root = scratch_path(spark, "feed-metrics")
    for i, part in enumerate(_landed(spark, sf)):
        _land(part, root, i)
    feed = staging.counted(readers.stream_status_json(spark, f"{root}/landing", "stations*", max_files_per_trigger=8))
    found = staging.observed(_ended(staging.start_staging(feed, f"{root}/staging", f"{root}/hop1", available_now=True)))
    return spark.createDataFrame([tuple(found[k] for k in ("processed", "rejected", "invalid"))], "PROCESSED long, REJECTED long, INVALID long")


@query("stream_latest_changes", _WITH + "SELECT " + _STATE_OUT_SQL + " FROM state")
def q_stream_latest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row per station as the state of a stream over a staging table, in several batches and two runs."""
    root = scratch_path(spark, "latest-stream")
    feed = _status(spark, sf)
    parts = feed.withColumn("_part", F.pmod(F.xxhash64("EVENT_ID"), F.lit(6)))
    source = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 8).parquet
    for run in (0, 1):
        parts.where(F.floor(F.col("_part") / 3) == run).drop("_part").write.mode("append").parquet(f"{root}/staging")
        _ended(start_latest(source(f"{root}/staging"), f"{root}/latest", f"{root}/checkpoint", ORDER, available_now=True))
    return present(status.enrich_status(LatestTable(spark, f"{root}/latest").read(), _master(spark, sf)).select(*STATE_OUT))


@query("upsert_event_time", _WITH + "SELECT " + _STATE_OUT_SQL + " FROM state")
def q_upsert_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrival batches where the newer report wins, whichever comes first."""
    return present(_run_two_batches(spark, sf, "event_time").read().select(*STATE_OUT))


@query(
    "rejected_ids",
    "SELECT count(*) AS N_ROWS, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 = 0 AND user_id IS NOT NULL) AS N_NOT_NUMERIC, "
    "count(*) AS N_PROCESSED, count(*) FILTER (user_id IS NULL OR event_id % 7 = 0 OR event_id % 5 = 0) AS N_REJECTED, "
    "count(DISTINCT user_id) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0) AS N_STATIONS FROM events",
)
def q_rejected_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A landed feed where some polls have no id and some no numeric one: what the reader and the refresh count."""
    root = scratch_path(spark, "rejects")
    feed = _status(spark, sf)
    text = F.when(F.col("EVENT_ID") % 7 == 0, None).when(F.col("EVENT_ID") % 5 == 0, F.concat(F.lit("s"), F.col("STATION_ID"))).otherwise(F.col("STATION_ID").cast("string"))
    objects = sinks.to_feed_shape(feed.withColumn("STATION_ID", text))
    sinks.write_snapshot_json(objects, f"{root}/landing", "20240101_000000")
    store = StateStore(spark, f"{root}/state")
    refresh_state(readers.read_status_json(spark, f"{root}/landing"), 0, store, _master(spark, sf))
    counts, commit = readers.reject_counts(spark, f"{root}/landing"), store.latest()
    stations = store.read().agg(F.count(F.lit(1)).alias("N_STATIONS"))
    return counts.select(
        F.col("ROWS").alias("N_ROWS"), F.col("STATION_ID").alias("N_NOT_NUMERIC"), F.lit(commit.rows).cast("long").alias("N_PROCESSED"), F.lit(commit.rejected).cast("long").alias("N_REJECTED")
    ).join(stations)


# ---------------------------------------------------------------------------------------
# Sources and sinks round trips
# ---------------------------------------------------------------------------------------

@query("json_roundtrip", _FEED_SQL)
def q_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Status -> two feed snapshots (A7) -> feed reader (A1) -> staging append (A5) -> scan (A10)."""
    _, first, second = _two_batches(spark, sf)
    base = scratch_path(spark, "landing")
    sinks.write_snapshot_json(sinks.to_feed_shape(first), base, "20240101_000000")
    sinks.write_snapshot_json(sinks.to_feed_shape(second), base, "20240101_000500")
    table = scratch_path(spark, "staging")
    sinks.append_staging(readers.read_status_json(spark, base), table)
    return readers.read_table(spark, table).select(*_FEED_COLS)


@query("load_once", _FEED_SQL)
def q_load_once(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots loaded by three loads; what is loaded already is left out (A4, A5)."""
    table = _loaded(spark, sf)
    return table.rows().select(*_FEED_COLS)


@query(
    "load_history",
    f"WITH st AS ({S.STATUS_SQL}) SELECT CAST(CASE WHEN STATUS IN ('click', 'view') THEN 0 ELSE 1 END AS BIGINT) AS LOAD_ID, 'new' AS STATUS, "
    "count(*) AS N_ROWS, true AS HAS_FILES FROM st GROUP BY 1",
)
def q_load_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history of those loads: rows by load, from files that are known by path, size and time (A4)."""
    history = _loaded(spark, sf).history().groupBy("LOAD_ID", "STATUS")
    return history.agg(F.sum("N_ROWS").alias("N_ROWS"), (F.min("FILE_SIZE") >= 0).alias("HAS_FILES"))


def _loaded(spark: SparkSession, sf: str) -> LoadedTable:
    _, first, second = _two_batches(spark, sf)
    root = scratch_path(spark, "load")
    table = LoadedTable(spark, f"{root}/staging")
    for i, part in enumerate((first, second)):
        _land(part, root, i)
        table.load(f"{root}/landing")
    table.load(f"{root}/landing")
    return table


@query("envelope_rows", _FEED_SQL)
def q_envelope_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The stations of a report time as one API payload {"data": {"stations": [...]}}, read back."""
    feed = sinks.to_feed_shape(_status(spark, sf))
    stations = feed.groupBy("last_reported").agg(F.collect_list(F.struct(*feed.columns)).alias("stations"))
    path = scratch_path(spark, "payloads")
    stations.select(F.struct("stations").alias("data")).write.json(path)
    return readers.read_envelope(spark, path, multi_line=False).select(*_FEED_COLS)


@query(
    "variant_fields",
    "SELECT CAST(event_id AS BIGINT) AS EVENT_ID, CAST(user_id AS BIGINT) AS STATION_ID, json_extract_string(props, '$.k') AS K_TEXT, "
    "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS K_NUMBER, event_type AS KIND, json_extract_string(props, '$.missing') AS MISSING FROM events",
)
def q_variant_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Feed objects with a part that no schema names, staged whole as VARIANT and asked afterwards (B1, A5)."""
    e = S.table(spark, sf, "events")
    objects = e.select(
        F.col("user_id").alias("station_id"),
        F.struct(F.col("event_id").alias("seen"), F.struct(F.from_json("props", "k string").alias("props"), F.col("event_type").alias("kind")).alias("of")).alias("vendor"),
    )
    root = scratch_path(spark, "variant")
    sinks.write_snapshot_json(objects, f"{root}/landing", "20240101_000000")
    sinks.append_staging(readers.read_status_variant(spark, f"{root}/landing"), f"{root}/staging")
    field = lambda path, kind="string": readers.variant_field("RAW", f"$.vendor.{path}", kind)
    return readers.read_table(spark, f"{root}/staging").select(
        field("seen", "long").alias("EVENT_ID"), "STATION_ID", field("of.props.k").alias("K_TEXT"), field("of.props.k", "long").alias("K_NUMBER"),
        field("of.kind").alias("KIND"), field("of.props.missing").alias("MISSING"),
    )


@query("csv_roundtrip", _WITH + "," + _BROKEN_SQL + "SELECT * FROM broken")
def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "brokendocks-csv")
    sinks.write_csv(_broken(spark, sf), path)
    return present(readers.read_broken_docks_csv(spark, path))


@query(
    "master_json_roundtrip",
    f"WITH m AS ({S.MASTER_SQL}) SELECT STATION_ID, STATION_NAME, ADDRESS, POST_CODE, CAPACITY, "
    "CAST(LAT AS DOUBLE) AS LAT, CAST(LON AS DOUBLE) AS LON FROM m",
)
def q_master_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two master snapshots written as feed files, read and reduced to the latest row per station."""
    m = _master(spark, sf)
    feed = m.select(
        F.col("STATION_ID").cast("string").alias("station_id"),
        F.col("STATION_NAME").alias("name"),
        F.col("ADDRESS").alias("address"),
        F.col("POST_CODE").alias("post_code"),
        F.col("CAPACITY").alias("capacity"),
        F.col("LAT").cast("string").alias("lat"),
        F.col("LON").cast("string").alias("lon"),
    )
    base = scratch_path(spark, "master")
    sinks.write_snapshot_json(feed.withColumn("capacity", F.lit(1)), base, "20240101_000000")
    sinks.write_snapshot_json(feed, base, "20240102_000000")
    out = ["STATION_ID", "STATION_NAME", "ADDRESS", "POST_CODE", "CAPACITY", "LAT", "LON"]
    read = readers.read_master_json(spark, base)
    return present(status.latest_per_station(read, ("SOURCE_FILE",)).select(*out), nullable_ints=())


@query("view_broken_docks", _WITH + "," + _BROKEN_SQL + "SELECT STATION_NAME, BROKEN_DOCKS FROM broken WHERE BROKEN_DOCKS > 1")
def q_view_broken_docks(spark: SparkSession, sf: str) -> DataFrame:
    """The named views through SQL text."""
    prefix = f"q{uuid.uuid4().hex[:8]}_"
    register_views(spark, _master(spark, sf), _state(spark, sf), pair_radius_m=PAIR_RADIUS_M, prefix=prefix)
    return spark.sql(f"SELECT STATION_NAME, BROKEN_DOCKS FROM {prefix}broken_docks WHERE BROKEN_DOCKS > 1")


def _type_sql(column: str, kind: str) -> str:
    # The other engine's TIMESTAMP has no zone; here that type has a name of its own.
    return f"replace(lower(typeof(CAST({column} AS {kind}))), 'timestamp', 'timestamp_ntz')"


@query(
    "sql_dashboard",
    _WITH
    + "," + _BROKEN_SQL
    + f"""
SELECT s.STATION_ID, round({_ENTROPY_SQL}, 12) AS ENTROPY, {_COLOR_SQL} AS COLOR,
       round_even(CAPACITY * 0.45e0 - NUM_BIKES_AVAILABLE, 0) AS NEED, round_even(CAPACITY * 0.5e0 - NUM_BIKES_AVAILABLE, 0) AS NEED_AFTER, CAST(b.BROKEN_DOCKS AS DOUBLE) AS BROKEN_DOCKS
FROM (SELECT *, OCCUPATION_RATIO AS r FROM state) s LEFT JOIN (SELECT STATION_ID, BROKEN_DOCKS FROM broken WHERE BROKEN_DOCKS > 3) b ON s.STATION_ID = b.STATION_ID
""",
)
def q_sql_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's questions as SQL text alone: scalar and table functions over the views."""
    p = f"q{uuid.uuid4().hex[:8]}_"
    register_views(spark, _master(spark, sf), _state(spark, sf), pair_radius_m=PAIR_RADIUS_M, prefix=p)
    register_functions(spark, p)
    return spark.sql(
        f"SELECT s.STATION_ID, round({p}binary_entropy(OCCUPATION_RATIO), 12) AS ENTROPY, {p}occupancy_color(OCCUPATION_RATIO) AS COLOR, "
        f"{p}bike_need(CAPACITY, NUM_BIKES_AVAILABLE) AS NEED, {p}bike_need(CAPACITY, NUM_BIKES_AVAILABLE, 0.5e0) AS NEED_AFTER, "
        f"CAST(b.BROKEN_DOCKS AS DOUBLE) AS BROKEN_DOCKS "
        f"FROM {p}current_state s LEFT JOIN {p}broken_docks_over(3) b ON s.STATION_ID = b.STATION_ID"
    )


@query("catalog_tables", _WITH + "," + _BROKEN_SQL + "SELECT * FROM broken")
def q_catalog_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Master and state as declared, bucketed tables of a schema; broken docks from their join, which shuffles neither."""
    schema = f"q{uuid.uuid4().hex[:8]}"
    create_tables(spark, schema, scratch_path(spark, "catalog"), buckets=8)
    master = replace_table(_master(spark, sf), f"{schema}.stations")
    return present(docks.broken_docks(master, replace_table(_state(spark, sf), f"{schema}.current_state")))


_TYPED_COLUMNS = {"OCCUPATION_RATIO": "DECIMAL(12,4)", "LAT": "DECIMAL(12,7)", "LON": "DECIMAL(12,7)", "LAST_REPORTED_TST": "TIMESTAMP"}


@query(
    "declared_types",
    _WITH
    + "SELECT STATION_ID, "
    + ", ".join(f"CAST(CAST({c} AS {t}) AS VARCHAR) AS {c}, {_type_sql(c, t)} AS {c}_TYPE" for c, t in _TYPED_COLUMNS.items())
    + " FROM state",
)
def q_declared_types(spark: SparkSession, sf: str) -> DataFrame:
    """Decimals and time stamps of the state with their types and all their places."""
    shown = [
        col
        for c in _TYPED_COLUMNS
        for col in (F.col(c).cast("string").alias(c), F.expr(f"typeof({c})").alias(f"{c}_TYPE"))
    ]
    return _state(spark, sf).select("STATION_ID", *shown)


@query(
    "file_inventory",
    "SELECT 'events.parquet' AS FILE_NAME, count(*) AS N_ROWS, true AS HAS_SIZE, true AS HAS_TIME FROM events "
    "UNION ALL SELECT 'orders.parquet', count(*), true, true FROM orders",
)
def q_file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The directory listing with sizes, times and rows of two tables' files."""
    files = [readers.file_inventory(spark, f"{sf.rstrip('/')}/{n}.parquet", "parquet") for n in ("events", "orders")]
    inv = files[0].unionByName(files[1])
    return inv.select("FILE_NAME", "N_ROWS", (F.col("FILE_SIZE") > 0).alias("HAS_SIZE"), F.col("MODIFIED").isNotNull().alias("HAS_TIME"))
