"""Grid pair joins and nearest neighbour against brute force."""

import itertools
import math
import random

import pytest

from stationflow.functions import columns as C
from stationflow.operators import geo


def hav(lat1, lon1, lat2, lon2, R=C.EARTH_RADIUS_M):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    dp = p2 - p1
    dl = math.radians(lon2) - math.radians(lon1)
    h = math.sin(dp / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


def points(seed=7, n=300):
    rnd = random.Random(seed)
    pts = []
    for i in range(n):
        if i % 5 == 0:  # a dense cluster
            lat, lon = 41.39 + rnd.random() * 0.002, 2.17 + rnd.random() * 0.002
        else:
            lat, lon = 41.30 + rnd.random() * 0.2, 2.05 + rnd.random() * 0.25
        pts.append((i, round(lat, 7), round(lon, 7)))
    pts += [(1000, pts[3][1], pts[3][2]), (1001, pts[3][1], pts[3][2])]  # exact duplicates
    pts += [(2000, 60.0, 10.0)]  # far away, high latitude
    return pts


def frame(spark, pts):
    return spark.createDataFrame(pts, "STATION_ID long, LAT double, LON double")


@pytest.mark.parametrize("radius", [150.0, 1500.0])
def test_pairs_within_equals_brute_force(spark, radius):
    pts = points()
    got = {(r.SRC_STATION_ID, r.TGT_STATION_ID): r.DISTANCE for r in geo.pairs_within(frame(spark, pts), radius).collect()}
    want = {}
    for a, b in itertools.combinations(pts, 2):
        d = hav(a[1], a[2], b[1], b[2])
        if d <= radius:
            want[(min(a[0], b[0]), max(a[0], b[0]))] = d
    assert set(got) == set(want)
    for k, d in want.items():
        assert math.isclose(got[k], d, rel_tol=1e-9, abs_tol=1e-6)


def test_degree_pairs_ordered_and_symmetric(spark):
    pts = points(seed=3, n=150)
    r = 0.01
    got = {(x.SRC_STATION_ID, x.TGT_STATION_ID) for x in geo.degree_pairs_within(frame(spark, pts), r).collect()}
    want = set()
    for a, b in itertools.permutations(pts, 2):
        if math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= r:
            want.add((a[0], b[0]))
    assert got == want
    assert all((j, i) in got for i, j in got)


def test_nearest_station_equals_brute_force(spark):
    pts = points(seed=11, n=250)
    pts += [(3000, 41.5, 2.3), (3001, 41.5, 2.3002), (3002, 41.5, 2.2998)]  # tie: 3001 and 3002 equidistant from 3000
    got = {r.STATION_ID: (r.NEAREST_ID, r.DISTANCE) for r in geo.nearest_station(frame(spark, pts)).collect()}
    assert len(got) == len(pts)
    for a in pts:
        best = min(
            ((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0]) for b in pts if b[0] != a[0]),
        )
        assert got[a[0]][0] == best[1], a
        assert math.isclose(got[a[0]][1], best[0], abs_tol=1e-12)
    assert got[3000][0] == 3001


def test_nearest_station_single_point(spark):
    got = geo.nearest_station(frame(spark, [(1, 41.0, 2.0)])).collect()
    assert [(r.STATION_ID, r.NEAREST_ID) for r in got] == [(1, None)]


def test_area_mean_ratio(spark):
    df = spark.createDataFrame(
        [(41.001, 2.001, 0.2), (41.002, 2.002, 0.4), (41.003, 2.003, None), (41.051, 2.001, None), (41.101, 2.001, 0.5)],
        "LAT double, LON double, RATIO double",
    )
    got = {(r.CELL_LAT, r.CELL_LON): (r.N_STATIONS, r.MEAN_RATIO, r.COLOR) for r in geo.area_mean_ratio(df, 0.01).collect()}
    n, mean, color = got[(4100, 200)]
    assert n == 2 and math.isclose(mean, 0.3, abs_tol=1e-12)
    assert color == "#00bf3f"  # green int(255*0.3/0.4)=191, blue int(255*0.1/0.4)=63
    assert got[(4105, 200)] == (0, 0.0, "#0000ff")  # only missing ratios -> 0
    assert got[(4110, 200)][2] == "#00FF00"


def test_pairs_cover_all_when_radius_exceeds_extent(spark):
    pts = points(seed=5, n=60)[:60]
    got = geo.pairs_within(frame(spark, pts), 200_000.0).collect()
    n = len(pts)
    assert len(got) == n * (n - 1) // 2
    assert all(r.SRC_STATION_ID < r.TGT_STATION_ID for r in got)


def test_pair_plans_have_no_cross_join(spark):
    df = frame(spark, points(n=50))
    for q in (geo.pairs_within(df, 1500.0), geo.degree_pairs_within(df, 0.01)):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_station_dense_cluster(spark):
    rnd = random.Random(9)
    pts = [(i, 41.3 + rnd.random() * 0.2, 2.1 + rnd.random() * 0.2) for i in range(120)]
    # a third of the stations packed into a 1e-5 degree square (distinct coordinates)
    pts += [(1000 + i, 41.4 + rnd.random() * 1e-5, 2.2 + rnd.random() * 1e-5) for i in range(60)]
    got = {r.STATION_ID: (r.NEAREST_ID, r.DISTANCE) for r in geo.nearest_station(frame(spark, pts), cell_target=8).collect()}
    for a in pts:
        best = min((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0]) for b in pts if b[0] != a[0])
        assert got[a[0]][0] == best[1], a


def globe(spark, pts, radius, **kw):
    got = {(r.SRC_STATION_ID, r.TGT_STATION_ID): r.DISTANCE for r in geo.pairs_within(frame(spark, pts), radius, **kw).collect()}
    want = {(a[0], b[0]): hav(a[1], a[2], b[1], b[2]) for a, b in itertools.combinations(pts, 2)}
    want = {k: d for k, d in want.items() if d <= radius}
    assert set(got) == set(want)
    assert all(math.isclose(got[k], d, rel_tol=1e-9, abs_tol=1e-3) for k, d in want.items())
    return len(got)


def test_pairs_at_any_radius_around_the_globe(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)]
    pts += [(100, 10.0, 179.999), (101, 10.0, -179.999), (102, 90.0, 0.0), (103, -90.0, 50.0), (104, 89.99, 0.0), (105, 89.99, 180.0), (106, 0.0, 0.0), (107, 0.0, 180.0)]
    assert globe(spark, pts, 4e7) == len(pts) * (len(pts) - 1) // 2
    assert globe(spark, pts, 1_500.0) >= 1  # across +-180 degrees
    globe(spark, pts, 3_000_000.0)
    globe(spark, pts, 12_000_000.0)


def test_a_station_at_the_pole_leaves_other_cells_small(spark):
    near, probes = geo._bands(geo._points(frame(spark, [(1, 41.4, 2.17), (2, 90.0, 0.0)]), "STATION_ID", "LAT", "LON"), 1500.0 / C.EARTH_RADIUS_M)
    columns = {r.a_id: r._col for r in near.collect()}
    assert columns[2] == 0 and columns[1] > 50
    assert probes.where("b_id = 1").count() == 6


def test_a_third_of_the_stations_in_one_cell(spark):
    rnd = random.Random(8)
    pts = [(i, 41.4 + rnd.random() * 1e-4, 2.1 + rnd.random() * 1e-4) for i in range(100)]
    pts += [(100 + i, 41.3 + rnd.random() * 0.2, 2.0 + rnd.random() * 0.2) for i in range(200)]
    assert globe(spark, pts, 1500.0, shard_rows=16) >= 4950
    got = {(r.SRC_STATION_ID, r.TGT_STATION_ID) for r in geo.degree_pairs_within(frame(spark, pts), 0.01, shard_rows=16).collect()}
    assert got == {(a[0], b[0]) for a, b in itertools.permutations(pts, 2) if math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.01}


def test_nearest_with_a_cluster_and_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(geo, "SHARD_ROWS", 8)
    rnd = random.Random(9)
    pts = [(i, 41.4 + rnd.random() * 1e-5, 2.1 + rnd.random() * 1e-5) for i in range(150)] + [(500, -80.0, 170.0), (501, -79.0, 170.0)]
    got = {r.STATION_ID: r.NEAREST_ID for r in geo.nearest_station(frame(spark, pts)).collect()}
    for a in pts:
        best = min((math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), b[0]) for b in pts if b[0] != a[0])
        assert got[a[0]] == best[1]


@pytest.mark.parametrize("search", ["pairs_within", "degree_pairs_within", "update_pairs", "sql"])
def test_the_pairs_of_one_small_file_are_dealt_over_tasks(spark, tmp_dir, search):
    # A table of one file with few bytes, and many pairs: no task makes more than a part of them.
    from pyspark.sql import functions as F
    from stationflow.plans.sql_functions import register_functions

    rnd = random.Random(12)
    pts = [(i, 41.4 + rnd.random() * 0.005, 2.1 + rnd.random() * 0.005) for i in range(400)]
    frame(spark, pts).coalesce(1).write.parquet(f"{tmp_dir}/stations")
    stations = spark.read.parquet(f"{tmp_dir}/stations")
    if search == "update_pairs":
        none = geo.pairs_within(stations.where("false"), 1500.0)
        got = geo.update_pairs(none, stations.where("false"), stations, 1500.0)
        assert got.count() == 400 * 399 // 2
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
        return
    if search == "sql":
        stations.createOrReplaceTempView("dealt_stations")
        stations.selectExpr("STATION_ID", "'' AS STATION_NAME", "0L AS BROKEN_DOCKS").createOrReplaceTempView("dealt_broken_docks")
        register_functions(spark, "dealt_")
        got = spark.sql("SELECT * FROM dealt_station_pairs_within(1500)")
    else:
        got = getattr(geo, search)(stations, 1500.0 if search == "pairs_within" else 0.01)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 400 * 399 // (1 if search == "degree_pairs_within" else 2)
    assert max(shares) <= sum(shares) / 3


@pytest.mark.parametrize("shard_rows", [None, 16])
def test_all_pairs_are_every_pair_at_any_distance(spark, shard_rows):
    pts = points()  # one station is thousands of kilometres from the others
    got = {(r.SRC_STATION_ID, r.TGT_STATION_ID): r.DISTANCE for r in geo.all_pairs(frame(spark, pts), shard_rows=shard_rows).collect()}
    assert len(got) == len(pts) * (len(pts) - 1) // 2
    for a, b in itertools.combinations(pts, 2):
        assert math.isclose(got[min(a[0], b[0]), max(a[0], b[0])], hav(a[1], a[2], b[1], b[2]), rel_tol=1e-9, abs_tol=1e-6)


def test_all_pairs_of_odd_rows(spark):
    nan = float("nan")
    pts = [(1, 41.0, 2.0), (1, 41.0, 2.0), (2, 42.0, 2.0), (3, None, 2.0), (4, 41.0, None), (None, 41.0, 2.0), (5, nan, 2.0), (6, 41.0, math.inf)]
    rows = [tuple(r) for r in geo.all_pairs(frame(spark, pts)).collect()]
    with_id = [p[0] for p in pts if p[0] is not None]
    assert sorted(r[:2] for r in rows) == sorted((a, b) for a in with_id for b in with_id if a < b)
    known = [r for r in rows if r[2] is not None]
    assert [r[:2] for r in known] == [(1, 2), (1, 2)]
    assert all(math.isclose(r[2], hav(41.0, 2.0, 42.0, 2.0), rel_tol=1e-9) for r in known)
    assert geo.all_pairs(frame(spark, pts[:2])).count() == 0 == geo.all_pairs(frame(spark, [])).count()


def test_station_pairs_has_every_pair_of_the_master(spark, tmp_dir):
    import __spark_entry__ as E
    import duckdb
    from oracle import compare

    n = 40
    # Keys 0-39: latitudes 37e-4 degrees apart, so most pairs are farther apart than 1,500 m.
    spark.sql(f"SELECT id AS s_suppkey, concat('S', id) AS s_name, CAST(id % 25 AS INT) AS s_nationkey FROM range({n})").write.parquet(f"{tmp_dir}/supplier.parquet")
    got = E.queries()["station_pairs"](spark, tmp_dir).toPandas()
    assert len(got) == n * (n - 1) // 2 and got["DISTANCE"].max() > 10_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_dir}/supplier.parquet/*.parquet')")
    ok, msg = compare(got, con.execute(E.oracle_sql()["station_pairs"]).df())
    assert ok, msg


def test_all_pairs_of_one_small_file_are_dealt_over_tasks(spark, tmp_dir):
    from pyspark.sql import functions as F

    frame(spark, points(n=400)).coalesce(1).write.parquet(f"{tmp_dir}/stations")
    got = geo.all_pairs(spark.read.parquet(f"{tmp_dir}/stations"))
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 403 * 402 // 2
    assert max(shares) <= sum(shares) / 3
