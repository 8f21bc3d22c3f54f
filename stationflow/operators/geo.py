"""Distances between stations.

Pair searches run as equi-joins on grid
cells sized from the search radius, so the work grows with the number of
pairs that are actually close, not with n^2. A cell that holds many points is
split into shards: its points are dealt out, and the probes of the cell go to
every shard, so no task holds a whole dense cell.

* ``all_pairs`` -- the distance of every unordered pair, however far apart: the
  only operator here that forms all of them, because they are its result.
  Stations are dealt into shards, and each two shards meet under a key of their own.
* ``pairs_within`` -- every unordered pair within ``max_distance_m`` metres
  (great-circle). Latitude bands as high as the radius; each band has columns
  of its own, wide enough for two points that close at its latitudes, and they
  close at +-180 degrees.
* ``degree_pairs_within`` -- the same with the reference's degree distance on a
  plane grid, as ordered pairs.
* ``nearest_station`` -- nearest other station by degree distance: each
  station searches its 3x3 cells on a level quadtree, starting at the coarsest
  level where its cell is sparse and moving one level coarser while
  unresolved; a match within one cell side is provably the nearest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import cut_lineage

# Own cell plus the 4 forward neighbours: each unordered pair of plane cells is visited once.
_HALF_NEIGHBOURS = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
_ALL_NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
# Relative slack on cell sizes so float rounding in floor(coord / step) cannot
# push a qualifying pair two cells apart (quotients stay below ~1e9, whose
# rounding error is ~1e-7).
_SLACK = 1.0 + 1e-6
# Points of one cell that one join key holds at most (on average, by a hash of the id), so a probe's row
# never stands for more pairs.
SHARD_ROWS = 512


def _points(stations: DataFrame, id_col: str, lat_col: str, lon_col: str) -> DataFrame:
    return stations.select(
        F.col(id_col).alias("_id"), F.col(lat_col).cast("double").alias("_lat"), F.col(lon_col).cast("double").alias("_lon")
    ).where(F.col("_id").isNotNull() & F.col("_lat").isNotNull() & F.col("_lon").isNotNull())


def _cells(df: DataFrame, lat_step: float, lon_step: float) -> DataFrame:
    return df.withColumn("_cy", F.floor(F.col("_lat") / F.lit(lat_step))).withColumn(
        "_cx", F.floor(F.col("_lon") / F.lit(lon_step))
    )


def _shifted(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """One copy of each row per neighbour offset, keyed by the neighbour cell."""
    arr = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return (
        df.withColumn("_off", F.explode(arr))
        .withColumn("_ny", F.col("_cy") + F.col("_off.dy"))
        .withColumn("_nx", F.col("_cx") + F.col("_off.dx"))
        .drop("_off")
    )


def _dealt(points: DataFrame) -> DataFrame:
    """Points dealt evenly over as many tasks as a shuffle has partitions, whichever side of the join streams.

    The pairs are many times the points, so tasks by the bytes of the points (one input file, or what
    AQE makes one partition of) would be far too few; a number that is asked for is kept.
    """
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id")


def _meet(points: DataFrame, probes: DataFrame, cell: list[str], shard_rows: int | None = None) -> DataFrame:
    """``points`` joined with the ``probes`` of their cell; crowded cells in shards.

    Both sides carry the cell columns; ``points`` has ``a_id``. The result has the
    columns of both. Only cells above ``shard_rows`` are kept in the table of counts, which both
    sides read: it stays in the plan, so nothing runs before the result is asked for.
    """
    shard_rows = shard_rows or SHARD_ROWS
    sizes = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_rows)
    crowded = sizes.select(*cell, F.ceil(F.col("_n") / F.lit(shard_rows)).cast("long").alias("_shards"))
    one = F.coalesce("_shards", F.lit(1).cast("long"))
    left = points.join(crowded, cell, "left").withColumn("_shard", F.pmod(F.xxhash64("a_id"), one)).drop("_shards")
    right = probes.join(crowded, cell, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("_shards")
    return left.join(right, [*cell, "_shard"]).drop("_shard")


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select(F.col("_id").alias(f"{name}_id"), F.col("_lat").alias(f"{name}_lat"), F.col("_lon").alias(f"{name}_lon"), *more)


def _bands(points: DataFrame, arc: float, some: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, probes) by latitude band and longitude column for a search of ``arc`` radians.

    A band is as high as the arc. Two points within the arc whose latitudes
    stay below phi are apart by a longitude of 2 asin(sin(arc / 2) / cos(phi)) at
    most; a band's columns are at least that wide for itself and the bands
    beside it, so three columns hold all partners. Near the poles one column is
    left. A probe goes to its own band and the one above; if only ``some`` points are
    probes, they go to the one below too.
    """
    height = math.degrees(arc) * _SLACK
    half = math.sin(arc / 2.0)

    def band(lat: Column) -> Column:
        return F.floor((lat + 90.0) / F.lit(height))

    def columns(of: Column) -> Column:
        reach = F.greatest(F.abs((of - 1) * F.lit(height) - 90.0), F.abs((of + 2) * F.lit(height) - 90.0))
        ratio = F.lit(half) / F.cos(F.radians(F.least(reach, F.lit(90.0))))
        width = F.degrees(2.0 * F.asin(F.least(ratio, F.lit(1.0)))) * _SLACK
        return F.when((reach >= 90.0) | (ratio >= 1.0), F.lit(1)).otherwise(F.greatest(F.floor(360.0 / width), F.lit(1))).cast("long")

    def column(lon: Column, n: Column) -> Column:
        turn = lon - 360.0 * F.floor(lon / 360.0)
        return F.least(F.floor(turn / (F.lit(360.0) / n)), n - 1)

    placed = points.withColumn("_band", band(F.col("_lat")))
    placed = placed.withColumn("_cols", columns(F.col("_band"))).withColumn("_col", column(F.col("_lon"), F.col("_cols")))
    home = placed if some is None else some.withColumn("_band", band(F.col("_lat")))
    bands = F.array(*[F.col("_band") + d for d in ((0, 1) if some is None else (-1, 0, 1))])
    probes = home.select("_id", "_lat", "_lon", F.col("_band").alias("_home"), F.explode(bands).alias("_band"))
    n = columns(F.col("_band"))
    at = column(F.col("_lon"), n)
    near = F.array_distinct(F.array(*[F.pmod(at + d, n) for d in (-1, 0, 1)]))
    probes = probes.withColumn("_col", F.explode(near))
    return _side(placed, "a", "_band", "_col"), _side(probes, "b", "_band", "_col", (F.col("_home") == F.col("_band")).alias("_own"))


def pairs_within(
    stations: DataFrame,
    max_distance_m: float,
    id_col: str = "STATION_ID",
    lat_col: str = "LAT",
    lon_col: str = "LON",
    radius_m: float = C.EARTH_RADIUS_M,
    shard_rows: int | None = None,
) -> DataFrame:
    """Unordered station pairs (SRC < TGT) within ``max_distance_m`` metres.

    Any radius is right: from half the circumference on, one cell is the whole
    globe and all pairs qualify, because they were asked for.
    """
    if max_distance_m <= 0:
        raise ValueError("max_distance_m must be positive")
    points = _dealt(_points(stations, id_col, lat_col, lon_col))
    near, probes = _bands(points, min(max_distance_m / radius_m, math.pi))
    dist = C.geo_distance_m("a_lon", "a_lat", "b_lon", "b_lat", radius_m)
    return (
        _meet(near, probes, ["_band", "_col"], shard_rows)
        # Inside a band each pair meets from both ends.
        .where((~F.col("_own") & (F.col("a_id") != F.col("b_id"))) | (F.col("a_id") < F.col("b_id")))
        .select(
            F.least("a_id", "b_id").alias("SRC_STATION_ID"),
            F.greatest("a_id", "b_id").alias("TGT_STATION_ID"),
            dist.alias("DISTANCE"),
        )
        .where(F.col("DISTANCE") <= F.lit(float(max_distance_m)))
    )


def all_pairs(
    stations: DataFrame,
    id_col: str = "STATION_ID",
    lat_col: str = "LAT",
    lon_col: str = "LON",
    radius_m: float = C.EARTH_RADIUS_M,
    shard_rows: int | None = None,
) -> DataFrame:
    """Every unordered station pair (SRC < TGT) with its distance in metres.

    A pair with a coordinate that is NULL or not finite has a NULL distance; rows of one id aren't
    paired with each other, and a NULL id has no pairs. A station goes to as many keys as there are
    shards, and a key holds two shards, so the rows that are shuffled are n times the shards and a
    key stands for ``shard_rows``^2 pairs.
    """
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(math.inf), F.col(c).cast("double"))
    points = stations.select(F.col(id_col).alias("_id"), finite(lat_col).alias("_lat"), finite(lon_col).alias("_lon")).where(F.col("_id").isNotNull())
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several keys a task even of a small table, so that tasks are alike. The count stays in the plan.
    least = math.ceil(4 * math.sqrt(tasks))
    count = points.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows or SHARD_ROWS)), F.lit(least)).cast("long")).scalar()
    placed = points.withColumn("_shards", count).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_shards")))
    up = F.explode(F.sequence(F.col("_own"), F.col("_shards") - 1))
    down = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own")))
    left = _side(placed.select("*", F.col("_own").alias("_i"), up.alias("_j")), "a", "_i", "_j")
    right = _side(placed.select("*", down.alias("_i"), F.col("_own").alias("_j")), "b", "_i", "_j")
    # A number that is asked for is kept: the bytes of the points say nothing about the pairs.
    left, right = (df.repartition(tasks, "_i", "_j") for df in (left, right))
    dist = C.geo_distance_m("a_lon", "a_lat", "b_lon", "b_lat", radius_m)
    known = F.col("a_lat").isNotNull() & F.col("a_lon").isNotNull() & F.col("b_lat").isNotNull() & F.col("b_lon").isNotNull()
    return (
        left.join(right.hint("merge"), ["_i", "_j"])
        .where(((F.col("_i") < F.col("_j")) & (F.col("a_id") != F.col("b_id"))) | (F.col("a_id") < F.col("b_id")))
        .select(
            F.least("a_id", "b_id").alias("SRC_STATION_ID"),
            F.greatest("a_id", "b_id").alias("TGT_STATION_ID"),
            F.when(known, dist).alias("DISTANCE"),
        )
    )


def update_pairs(
    pairs: DataFrame,
    before: DataFrame,
    after: DataFrame,
    max_distance_m: float,
    id_col: str = "STATION_ID",
    lat_col: str = "LAT",
    lon_col: str = "LON",
    radius_m: float = C.EARTH_RADIUS_M,
    shard_rows: int | None = None,
) -> DataFrame:
    """``pairs_within`` of ``after``, from that of ``before`` and what has changed.

    Pairs of stations that are gone or moved go; stations that are new or moved are searched
    against all. The work beside one comparison of both tables by id grows with the changed stations' neighbours.
    A station has one row; ids and coordinates that are NULL are left out, as there.
    """
    if max_distance_m <= 0:
        raise ValueError("max_distance_m must be positive")
    old, new = (_points(df, id_col, lat_col, lon_col) for df in (before, after))
    was = old.select("_id", F.struct("_lat", "_lon").alias("_was"))
    at = new.select("_id", F.struct("_lat", "_lon").alias("_at"))
    changed = cut_lineage(was.join(at, "_id", "full_outer").where(~F.col("_was").eqNullSafe(F.col("_at"))).select("_id", "_at"), "changed-stations")
    ids = changed.select("_id")
    kept = pairs
    for end in ("SRC_STATION_ID", "TGT_STATION_ID"):
        kept = kept.join(ids.withColumnRenamed("_id", end), end, "left_anti")
    moved = changed.where(F.col("_at").isNotNull()).select("_id", "_at._lat", "_at._lon")
    arc = min(max_distance_m / radius_m, math.pi)
    near, probes = _bands(_dealt(new), arc, _dealt(moved))
    dist = C.geo_distance_m("a_lon", "a_lat", "b_lon", "b_lat", radius_m)
    found = _meet(near, probes, ["_band", "_col"], shard_rows).where(F.col("a_id") != F.col("b_id"))
    found = found.select(F.least("a_id", "b_id").alias("SRC_STATION_ID"), F.greatest("a_id", "b_id").alias("TGT_STATION_ID"), dist.alias("DISTANCE"))
    # Two changed stations meet from both ends.
    found = found.where(F.col("DISTANCE") <= F.lit(float(max_distance_m))).groupBy("SRC_STATION_ID", "TGT_STATION_ID").agg(F.min("DISTANCE").alias("DISTANCE"))
    return kept.select("SRC_STATION_ID", "TGT_STATION_ID", "DISTANCE").unionByName(found)


def degree_pairs_within(
    stations: DataFrame,
    max_degrees: float,
    id_col: str = "STATION_ID",
    lat_col: str = "LAT",
    lon_col: str = "LON",
    shard_rows: int | None = None,
) -> DataFrame:
    """Ordered pairs (i != j) with degree distance <= ``max_degrees`` (D4 in long form).

    The dense n x n matrix is never built: each unordered close pair is found
    once on the grid and emitted in both directions.
    """
    if max_degrees <= 0:
        raise ValueError("max_degrees must be positive")
    step = max_degrees * _SLACK
    cells = _cells(_dealt(_points(stations, id_col, lat_col, lon_col)), step, step)
    probes = _shifted(cells, _HALF_NEIGHBOURS)
    own = ((F.col("_ny") == F.col("_cy")) & (F.col("_nx") == F.col("_cx"))).alias("_own")
    probes = _side(probes.withColumn("_own", own), "b", "_own", "_ny", "_nx").withColumnsRenamed({"_ny": "_cy", "_nx": "_cx"})
    d = C.degree_distance("a_lat", "a_lon", "b_lat", "b_lon")
    close = (
        _meet(_side(cells, "a", "_cy", "_cx"), probes, ["_cy", "_cx"], shard_rows)
        .where((~F.col("_own") & (F.col("a_id") != F.col("b_id"))) | (F.col("a_id") < F.col("b_id")))
        .select("a_id", "b_id", d.alias("DISTANCE"))
        .where(F.col("DISTANCE") <= F.lit(float(max_degrees)))
    )
    both = F.explode(
        F.array(
            F.struct(F.col("a_id").alias("I"), F.col("b_id").alias("J")),
            F.struct(F.col("b_id").alias("I"), F.col("a_id").alias("J")),
        )
    )
    return close.select(both.alias("p"), "DISTANCE").select(
        F.col("p.I").alias("SRC_STATION_ID"), F.col("p.J").alias("TGT_STATION_ID"), "DISTANCE"
    )


# Nearest neighbour: a quadtree of levels over the data's extent. Level L has
# cells of side span / 2^L (level 0 covers everything). Each station starts at
# the coarsest level whose cell holds at most NN_CELL_TARGET representatives,
# so a dense cluster is searched on a fine grid and never pairs with itself as
# a whole; unresolved stations move one level coarser per round.
NN_CELL_TARGET = 32
NN_MAX_LEVEL = 32


def _start_levels(placed: Callable[[DataFrame, Column], DataFrame], reps: DataFrame, queries: DataFrame, n: int, target: int) -> DataFrame:
    """``queries`` with the level ``_L`` at which each starts: the coarsest one whose cell
    holds at most ``target`` of the ``n`` representatives.

    Representatives are counted once, in the cells of one level about as fine as it takes if they
    lie evenly. Counts of coarser cells are sums of those (a cell's number there is its
    number shifted), so it is cells and not stations that meet every level. Where a
    cell of that level is crowded still, its representatives alone go on to finer ones.
    """
    found, top = [], 0
    at = lambda x, level: F.expr(f"cast(shiftright({x}, _B - {level}) as bigint)")
    while True:
        depth = 1 + max(0, math.ceil(math.log(max(n, 1) / target, 4)))
        bottom = min(NN_MAX_LEVEL, top + depth)
        own = lambda df: placed(df, F.array(F.lit(bottom))).withColumnRenamed("_L", "_B")
        cells = cut_lineage(own(reps).groupBy("_B", "_cy", "_cx").agg(F.count(F.lit(1)).alias("_n")), "nn-cells")
        levels = cells.withColumn("_L", F.explode(F.sequence(F.lit(top), F.lit(bottom))))
        levels = levels.select("*", at("_cy", "_L").alias("_py"), at("_cx", "_L").alias("_px"))
        crowded = levels.groupBy("_L", "_py", "_px").agg(F.sum("_n").alias("_all")).where(F.col("_all") > target)
        # The coarsest sparse level is the one below the finest crowded cell that holds the station.
        deepest = levels.join(crowded, ["_L", "_py", "_px"]).groupBy("_cy", "_cx").agg(F.max("_L").alias("_dense"), F.first("_n").alias("_n"))
        deepest = cut_lineage(deepest, "nn-dense")
        started = own(queries).join(deepest, ["_cy", "_cx"], "left")
        more = F.col("_dense").eqNullSafe(F.lit(bottom)) & F.lit(bottom < NN_MAX_LEVEL)
        level = F.least(F.coalesce(F.col("_dense") + 1, F.lit(top)), F.lit(NN_MAX_LEVEL))
        found.append(started.where(~more).select("_id", "_lat", "_lon", level.alias("_L")))
        full = deepest.where(F.col("_dense") == bottom)
        n = full.agg(F.max("_n")).first()[0] if bottom < NN_MAX_LEVEL else None
        if n is None:
            break
        crowds = full.select("_cy", "_cx")
        reps = cut_lineage(own(reps).join(crowds, ["_cy", "_cx"], "left_semi").select("_id", "_lat", "_lon"), "nn-crowds")
        queries = own(queries).join(crowds, ["_cy", "_cx"], "left_semi").select("_id", "_lat", "_lon")
        top = bottom + 1
    out = found[0]
    for more_rows in found[1:]:
        out = out.unionByName(more_rows)
    return out


def nearest_station(
    stations: DataFrame,
    id_col: str = "STATION_ID",
    lat_col: str = "LAT",
    lon_col: str = "LON",
    cell_target: int = NN_CELL_TARGET,
) -> DataFrame:
    """Nearest other station by degree distance, ties to the smaller id.

    Returns STATION_ID, NEAREST_ID, DISTANCE for every station with
    coordinates; NEAREST_ID is NULL when there is no other station.

    Stations sharing exact coordinates are answered by aggregation (distance
    0, smallest other id); the search runs over one representative per
    coordinate. A station searched at level L compares itself with the
    representatives of its 3x3 cells there; a best match within one cell side
    is provably the nearest, otherwise it retries one level coarser. Level 0
    is exhaustive, so every station ends with the exact answer.
    """
    pts = _points(stations, id_col, lat_col, lon_col)
    id_type = pts.schema["_id"].dataType
    # One row per exact coordinate: smallest id, count, second smallest id.
    # Stored once; every later step reads this station-sized table.
    first_ids = pts.groupBy("_lat", "_lon").agg(F.min("_id").alias("_id1"), F.count(F.lit(1)).alias("_n"))
    second_ids = (
        pts.join(first_ids.where(F.col("_n") > 1), ["_lat", "_lon"])
        .where(F.col("_id") != F.col("_id1"))
        .groupBy("_lat", "_lon")
        .agg(F.min("_id").alias("_id2"))
    )
    coords = cut_lineage(first_ids.join(second_ids, ["_lat", "_lon"], "left"), "nn-coords")
    dup_answers = (
        pts.join(coords.where(F.col("_n") > 1), ["_lat", "_lon"])
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("_id") == F.col("_id1"), F.col("_id2")).otherwise(F.col("_id1")).alias("NEAREST_ID"),
            F.lit(0.0).alias("DISTANCE"),
        )
    )
    reps = coords.select(F.col("_id1").alias("_id"), "_lat", "_lon")
    queries = coords.where(F.col("_n") == 1).select(F.col("_id1").alias("_id"), "_lat", "_lon")

    stats = reps.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_lat").alias("y0"),
        F.max("_lat").alias("y1"),
        F.min("_lon").alias("x0"),
        F.max("_lon").alias("x1"),
    ).first()
    n = stats["n"]
    if not n or n <= 1:
        lone = queries.select(
            F.col("_id").alias(id_col), F.lit(None).cast(id_type).alias("NEAREST_ID"), F.lit(None).cast("double").alias("DISTANCE")
        )
        return dup_answers.unionByName(lone)
    y0, x0 = stats["y0"], stats["x0"]
    span = max(stats["y1"] - y0, stats["x1"] - x0)
    base = max(span, 1e-9) * 2.0  # level-0 cell: every pair of points is in adjacent cells

    def cell(axis: str, origin: float, level: Column) -> Column:
        step = F.lit(base) / F.pow(F.lit(2.0), level)
        return F.floor((F.col(axis) - F.lit(origin)) / step)  # steps are halved exactly: a coarser number is a shift of a finer one

    def placed(df: DataFrame, level: Column | str) -> DataFrame:
        at = df.select("_id", "_lat", "_lon", (F.explode(level) if isinstance(level, Column) else F.col(level)).alias("_L"))
        return at.select("_id", "_lat", "_lon", "_L", cell("_lat", y0, F.col("_L")).alias("_cy"), cell("_lon", x0, F.col("_L")).alias("_cx"))

    pending = cut_lineage(_start_levels(placed, reps, queries, n, cell_target), "nn-pending")
    key = ["_L", "_cy", "_cx"]
    answers = [dup_answers]
    d = C.degree_distance("b_lat", "b_lon", "a_lat", "a_lon")
    # Every round lowers the level of the stations it leaves unresolved, and level
    # 0 resolves all, so the loop ends within NN_MAX_LEVEL + 1 rounds.
    for _ in range(NN_MAX_LEVEL + 1):
        # Candidates at the levels still searched only (33 at most), and there in searched cells only.
        levels = sorted(r["_L"] for r in pending.groupBy("_L").count().collect())
        if not levels:
            break
        probes = _shifted(placed(pending, "_L"), _ALL_NEIGHBOURS).drop("_cy", "_cx").withColumnsRenamed({"_ny": "_cy", "_nx": "_cx"})
        near = placed(reps, F.array(*map(F.lit, levels))).join(probes.select(*key).distinct(), key, "left_semi")
        met = _meet(_side(near, "a", *key), _side(probes, "b", *key), key).where("a_id <> b_id")
        best = met.groupBy("b_id").agg(F.min(F.struct(d.alias("d"), F.col("a_id").alias("c"))).alias("b"))
        step = F.lit(base) / F.pow(F.lit(2.0), F.col("_L"))
        ok = (F.col("_L") == 0) | (F.col("b").isNotNull() & (F.col("b.d") <= step / F.lit(_SLACK)))
        scored = pending.join(best.withColumnRenamed("b_id", "_id"), "_id", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
        scored = cut_lineage(scored, "nn-scored")
        answers.append(
            scored.where("ok").select(F.col("_id").alias(id_col), F.col("b.c").alias("NEAREST_ID"), F.col("b.d").alias("DISTANCE"))
        )
        pending = scored.where("not ok").select("_id", "_lat", "_lon", (F.col("_L") - 1).alias("_L"))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out


def area_mean_ratio(df: DataFrame, cell_deg: float = 0.01, ratio_col: str = "RATIO", threshold: float = C.COLOR_THRESHOLD) -> DataFrame:
    """Average ratio and its colour per lat/lon grid cell.

    The ratio travels as weight = ratio + 2 and is decoded by -2 (as the
    cluster icon does); missing ratios are skipped and an empty cell averages
    to 0.
    """
    w = (F.col(ratio_col).cast("double") + F.lit(2.0)) - F.lit(2.0)
    g = df.groupBy(
        F.floor(F.col("LAT").cast("double") / F.lit(cell_deg)).alias("CELL_LAT"),
        F.floor(F.col("LON").cast("double") / F.lit(cell_deg)).alias("CELL_LON"),
    ).agg(F.count(C.finite(w)).alias("N_STATIONS"), F.avg(C.finite(w)).alias("_mean"))
    mean = F.coalesce(F.col("_mean"), F.lit(0.0))
    return g.select(
        "CELL_LAT",
        "CELL_LON",
        "N_STATIONS",
        mean.alias("MEAN_RATIO"),
        C.occupancy_color(mean, threshold).alias("COLOR"),
    )
