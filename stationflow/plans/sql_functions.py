"""Functions that SQL text can call (U1, U2, A13): the dashboard's questions with parameters.

    register_functions(spark)
    spark.sql("SELECT STATION_ID, occupancy_color(OCCUPATION_RATIO) FROM current_state")
    spark.sql("SELECT * FROM broken_docks_over(3) ORDER BY BROKEN_DOCKS DESC LIMIT 10")
    spark.sql("SELECT * FROM station_pairs_within(800)")

They are SQL functions: their bodies become part of the query's plan, so filters and
columns are pushed through them and nothing runs outside the JVM. The table functions read the
temporary views ``stations`` and ``broken_docks`` of :func:`~.views.register_views`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import columns as C

_CHANNEL = "least(greatest(cast({} AS INT), 0), 255)"


def _channel(text: str) -> str:
    return _CHANNEL.format(text)


#: Name, parameters, result and body of each scalar function; they say what the column functions of the same names say.
SCALARS = {
    "binary_entropy": (
        "r DOUBLE",
        "DOUBLE",
        "CASE WHEN r IN (0e0, 1e0) THEN 0e0 WHEN r > 0e0 AND r < 1e0 THEN -r * log2(r) - (1e0 - r) * log2(1e0 - r) END",
    ),
    "occupancy_color": (
        f"r DOUBLE, t DOUBLE DEFAULT {C.COLOR_THRESHOLD}e0",
        "STRING",
        f"""CASE WHEN r IS NULL OR isnan(r) THEN NULL
  WHEN t <= 0e0 OR t >= 0.5e0 THEN raise_error('the threshold must lie strictly between 0 and 0.5')
  WHEN r >= 0.5e0 - t AND r <= 0.5e0 + t THEN '{C.BALANCED_COLOR}'
  WHEN r < 0.5e0 THEN format_string('#%02x%02x%02x', 0, {_channel('255e0 * r / (0.5e0 - t)')}, {_channel('255e0 * (0.5e0 - t - r) / (0.5e0 - t)')})
  ELSE format_string('#%02x%02x%02x', {_channel('255e0 * (r - (0.5e0 + t)) / (0.5e0 - t)')},
    {_channel('255e0 * (1e0 - (r - (0.5e0 + t)) / (0.5e0 - t))')}, 0) END""",
    ),
    "bike_need": (
        f"capacity DOUBLE, bikes DOUBLE, target DOUBLE DEFAULT {C.INITIAL_TARGET}e0",
        "DOUBLE",
        "rint(capacity * target - bikes)",
    ),
    "geo_distance_m": (
        "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE",
        "DOUBLE",
        f"""{2.0 * C.EARTH_RADIUS_M}e0 * asin(sqrt(least(sin((radians(lat2) - radians(lat1)) / 2e0) * sin((radians(lat2) - radians(lat1)) / 2e0)
  + cos(radians(lat1)) * cos(radians(lat2)) * sin((radians(lon2) - radians(lon1)) / 2e0) * sin((radians(lon2) - radians(lon1)) / 2e0), 1e0)))""",
    ),
}


def _cube(function: str) -> str:
    """The station's cell in a grid of cubes as long as the chord of the radius, in the ball's own
    coordinates: two stations within the radius differ by one cell at most on each axis,
    at the poles and at the date line too."""
    side = f"(2.000002e0 * sin(least({function}.radius / {C.EARTH_RADIUS_M}e0, pi()) / 2e0))"
    axes = {"x": "cos(radians(lat)) * cos(radians(lon))", "y": "cos(radians(lat)) * sin(radians(lon))", "z": "sin(radians(lat))"}
    return ", ".join(f"floor({at} / {side}) AS {name}" for name, at in axes.items())


def _pairs(prefix: str, name: str, tasks: int) -> str:
    # The points are dealt evenly over the tasks, because the pairs are many times the points.
    points = f"SELECT /*+ REPARTITION({tasks}, id) */ * FROM (SELECT STATION_ID AS id, cast(LAT AS DOUBLE) AS lat, cast(LON AS DOUBLE) AS lon FROM {prefix}stations WHERE STATION_ID IS NOT NULL AND LAT IS NOT NULL AND LON IS NOT NULL)"
    placed = f"SELECT id, lat, lon, {_cube(name)} FROM ({points})"
    # A probe goes to the 27 cells around it.
    probes = f"SELECT id, lat, lon, y, z, explode(sequence(x - 1, x + 1)) AS x FROM ({placed})"
    probes = f"SELECT id, lat, lon, x, z, explode(sequence(y - 1, y + 1)) AS y FROM ({probes})"
    probes = f"SELECT id, lat, lon, x, y, explode(sequence(z - 1, z + 1)) AS z FROM ({probes})"
    met = f"SELECT a.id AS src, b.id AS tgt, {prefix}geo_distance_m(a.lon, a.lat, b.lon, b.lat) AS d FROM ({placed}) a JOIN ({probes}) b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.id < b.id"
    return f"SELECT src, tgt, d FROM ({met}) WHERE d <= {name}.radius"


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the scalar functions ``binary_entropy``, ``occupancy_color``, ``bike_need`` and ``geo_distance_m``,
    and the table functions ``station_pairs_within(radius)`` (metres) and ``broken_docks_over(least)``,
    all with ``prefix`` before their names; returns the names. The views have to be there."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    pairs, broken = f"{prefix}station_pairs_within", f"{prefix}broken_docks_over"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {pairs}(radius DOUBLE) RETURNS TABLE(SRC_STATION_ID BIGINT, TGT_STATION_ID BIGINT, DISTANCE DOUBLE) "
        f"RETURN {_pairs(prefix, pairs, int(spark.conf.get('spark.sql.shuffle.partitions')))}"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {broken}(least BIGINT DEFAULT 1) RETURNS TABLE(STATION_ID BIGINT, STATION_NAME STRING, BROKEN_DOCKS BIGINT) "
        f"RETURN SELECT STATION_ID, STATION_NAME, BROKEN_DOCKS FROM {prefix}broken_docks WHERE BROKEN_DOCKS > {broken}.least"
    )
    return [*(prefix + n for n in SCALARS), pairs, broken]
