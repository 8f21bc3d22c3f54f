"""Route planner: a hand-computed walk, the seeded start, invariants, zone splitting."""

import math

import numpy as np
import pytest

import __spark_entry__ as E
from stationflow.operators import balance
from stationflow.operators.unvisited import Unvisited

COLS = "STATION_ID long, STATION_NAME string, LAT double, LON double, CAPACITY long, NUM_BIKES_AVAILABLE long, " \
       "NUM_DOCKS_AVAILABLE long, OCCUPATION_RATIO double, TOTAL_CAPACITY long, RATIO double, ZONE string"


def feats(spark, rows):
    full = []
    for sid, lat, lon, cap, bikes, docks, zone in rows:
        ratio = None if not cap else round(bikes / cap, 4)
        full.append((sid, f"s{sid}", lat, lon, cap, bikes, docks, ratio, cap, ratio, zone))
    return spark.createDataFrame(full, COLS)


HAND = [
    (1, 0.0, 0.0, 20, 18, 2, "A"),
    (2, 0.0, 1.0, 20, 2, 18, "A"),
    (3, 0.0, 3.0, 10, 9, 1, "A"),
    (4, 0.0, 6.0, 20, 0, 20, "A"),
    (5, 0.0, 0.5, None, 3, 3, "A"),  # no capacity: no ratio, never a candidate
    (6, 5.0, 5.0, 20, 10, 10, "B"),  # a zone with one candidate: no legs
]


def test_hand_computed_walk(spark):
    legs = balance.plan_routes(feats(spark, HAND), "ZONE", 20, start="max_surplus").orderBy("ZONE", "LEG_NO").collect()
    got = [(r.ZONE, r.LEG_NO, r.FROM_ID, r.TO_ID, r.AMOUNT, r.ACTION, r.LOAD_AFTER, r.BIKES_AFTER, r.DOCKS_AFTER, r.RATIO_AFTER, r.NEED_AFTER) for r in legs]
    assert got == [
        ("A", 1, 1, 2, 9, "Picked up 9 bikes", 9, 9, 11, 0.45, 1.0),
        ("A", 2, 2, 3, 4, "Dropped off 4 bikes", 5, 6, 14, 0.3, 4.0),
        ("A", 3, 3, 4, 4, "Picked up 4 bikes", 9, 5, 5, 0.5, 0.0),
    ]


def test_seeded_start(spark):
    legs = balance.plan_routes(feats(spark, HAND), "ZONE", 20).where("ZONE = 'A'").orderBy("LEG_NO").collect()
    surplus_positions = [0, 2]  # ids 1 and 3 have NEED < 0 among candidates sorted by id
    first = np.random.RandomState(42).choice(surplus_positions)
    assert legs[0].FROM_ID == [1, 2, 3, 4][first]


def test_apply_plan_and_metrics(spark):
    f = feats(spark, HAND)
    legs = balance.plan_routes(f, "ZONE", 20, start="max_surplus")
    applied = {r.STATION_ID: r for r in balance.apply_plan(f, legs).collect()}
    assert len(applied) == 6
    assert (applied[1].NUM_BIKES_AVAILABLE, applied[1].NUM_DOCKS_AVAILABLE, applied[1].RATIO, applied[1].NEED) == (9, 11, 0.45, 1.0)
    assert (applied[4].NUM_BIKES_AVAILABLE, applied[4].NEED, applied[4].INITIAL_RATIO) == (0, 9.0, 0.0)  # reached, not served
    assert applied[5].NEED is None
    report, h0, h1 = balance.plan_metrics(balance.apply_plan(f, legs))
    assert report.count() == 1 and h0.count() == 40 and h1.count() == 40
    plan = balance.route_text(legs).first()
    assert plan.TEXT.splitlines()[:2] == [
        "Bike Redistribution Plan:",
        "Bus Picked up 9 bikes, then moved from Station 1 to Station 2.",
    ]
    assert plan.TEXT.endswith("Station 4.\n") and len(plan.TEXT.splitlines()) == 4
    text = balance.route_legs(legs, f).orderBy("LEG_NO").first()
    assert text.TEXT == "Bus Picked up 9 bikes, then moved from Station 1 to Station 2."
    assert (text.FROM_LAT, text.TO_LON) == (0.0, 1.0)


def test_invariants_on_driver_tables(spark):
    legs = E.queries()["plan_routes"](spark, "/root/testdata/sf0.01").toPandas()
    feats_pdf = E.queries()["station_features"](spark, "/root/testdata/sf0.01").toPandas().set_index("STATION_ID")
    assert len(legs) > 0
    assert legs.FROM_ID.is_unique
    for zone, g in legs.groupby("ZONE"):
        g = g.sort_values("LEG_NO")
        assert g.LEG_NO.tolist() == list(range(1, len(g) + 1))
        assert (g.TO_ID.iloc[:-1].to_numpy() == g.FROM_ID.iloc[1:].to_numpy()).all()  # legs chain
        assert ((g.LOAD_AFTER >= 0) & (g.LOAD_AFTER <= 20)).all()
        picked = g[g.ACTION.str.startswith("Picked")].AMOUNT.sum()
        dropped = g[g.ACTION.str.startswith("Dropped")].AMOUNT.sum()
        assert picked - dropped == g.LOAD_AFTER.iloc[-1]
        before = feats_pdf.loc[g.FROM_ID]
        assert ((g.BIKES_AFTER.to_numpy() + g.DOCKS_AFTER.to_numpy()) == (before.NUM_BIKES_AVAILABLE + before.NUM_DOCKS_AVAILABLE).to_numpy()).all()


def test_a_group_follows_from_the_station_alone(spark):
    small = [(i, 41.0 + (i % 7) * 0.01, 2.0 + (i // 7) * 0.01, 20, 15 if i % 2 else 2, 5, "Z") for i in range(30)]
    more = small + [(1000 + i, 45.0 + i * 0.001, 3.0, 20, 5, 5, "Y") for i in range(200)]
    for kw in ({}, {"cell_deg": 0.05}, {"trucks": 3}):
        plans = [balance.plan_routes(feats(spark, rows), "ZONE", start="max_surplus", **kw).where("FROM_ID < 1000") for rows in (small, more)]
        legs = [sorted(map(str, p.collect())) for p in plans]
        assert legs[0] == legs[1] and legs[0]


def test_every_candidate_of_a_group_is_in_a_leg(spark):
    rows = [(i, 41.0 + (i * 37 % 101) * 0.001, 2.0 + (i * 53 % 97) * 0.001, 20, i % 21, 20 - i % 21, "Z") for i in range(120)]
    rows += [(500 + i, 42.0, 3.0, 20, 5, 5, "Z") for i in range(25)]  # one point, 25 stations
    legs = balance.plan_routes(feats(spark, rows), "ZONE").collect()
    assert len(legs) == 144 and {x for r in legs for x in (r.FROM_ID, r.TO_ID)} == {r[0] for r in rows}


def test_missing_docks_and_coordinates_survive(spark):
    rows = [(1, 0.0, 0.0, 20, 18, None, "A"), (2, 0.0, 1.0, 20, 2, None, "A"), (3, None, None, 20, 2, 18, "A"), (4, 0.0, 2.0, 20, 3, 17, "A")]
    legs = balance.plan_routes(feats(spark, rows), "ZONE", start="max_surplus").orderBy("LEG_NO").collect()
    assert [(r.FROM_ID, r.TO_ID, r.AMOUNT, r.DOCKS_AFTER) for r in legs] == [(1, 2, 9, None), (2, 4, 4, None), (4, 3, 3, 14)]


def test_max_surplus_start_is_fixed(spark):
    tie = [(9, 0.0, 0.0, 20, 18, 2, "A"), (4, 1.0, 0.0, 20, 18, 2, "A"), (2, 2.0, 0.0, 20, 2, 18, "A")]
    none = [(9, 0.0, 0.0, 20, 2, 2, "A"), (4, 1.0, 0.0, 20, 3, 2, "A")]
    for rows in (tie, none):
        assert balance.plan_routes(feats(spark, rows), "ZONE", start="max_surplus").where("LEG_NO = 1").first().FROM_ID == 4


def test_single_route_without_zone(spark):
    legs = balance.plan_routes(feats(spark, HAND), None, 20, start="max_surplus").collect()
    assert len(legs) == 4  # 5 candidates city-wide (ids 1,2,3,4,6) -> 4 legs


def test_start_option_is_checked(spark):
    with pytest.raises(ValueError):
        balance.plan_routes(feats(spark, HAND), "ZONE", start="nearest")


def plain_order(place, start):
    """The walk by a scan of all stations left."""
    stops, left = [start], [i for i in range(len(place)) if i != start]
    while left:
        away = np.sqrt(((place[left] - place[stops[-1]]) ** 2).sum(axis=1))
        best = left[int(np.where(np.isnan(away), np.inf, away).argmin())]
        stops.append(best)
        left.remove(best)
    return stops


@pytest.mark.parametrize("n, grid", [(1, False), (2, True), (33, True), (500, False), (2000, True), (2000, False)])
def test_the_tree_walks_as_the_scan(n, grid):
    rng = np.random.default_rng(n + grid)
    place = rng.random((n, 2))
    if grid:
        place = np.round(place * 12) / 12  # many equal places and equal distances
    if n > 30:
        place[rng.integers(0, n, 6)] = np.nan
        place[rng.integers(0, n, 4), 0] = np.nan
    for start in {0, n // 2, int(np.isnan(place).any(axis=1).argmax())}:
        left = Unvisited(place)
        left.take(start)
        stops = [start]
        for _ in range(n - 1):
            stops.append(left.nearest(stops[-1]))
            left.take(stops[-1])
        assert stops == plain_order(place, start)


def test_groups_stay_small_where_a_zone_is_large(spark):
    # a third of all stations in one zone: the cells, not the zones, bound a task
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.random()), float(rng.random()), 20, int(rng.integers(0, 20)), 5, "A" if i % 3 == 0 else f"z{i % 40}") for i in range(3000)]
    f = feats(spark, rows)
    legs = balance.plan_routes(f, "ZONE", cell_deg=0.1)
    sizes = legs.groupBy("ZONE").count().agg({"count": "max"}).first()[0]
    assert sizes <= 30 and legs.count() > 1000
    assert legs.groupBy("FROM_ID").count().where("count > 1").isEmpty()


def zone_tables(folder, n=24):
    """``n`` stations of one zone, spread over several cells of 0.05 degrees, and a poll of each."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS s_suppkey, 'S' || i AS s_name, 7 AS s_nationkey, 0e0 AS s_acctbal FROM range({n}) t(i)) TO '{folder}/supplier.parquet'")
    con.execute(
        f"COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CAST(i AS BIGINT) AS user_id, 'view' AS event_type, "
        f"CAST(i * 7 % 13 AS DOUBLE) AS value, '{{\"k\": ' || (i * 5 % 23) || '}}' AS props FROM range({n}) t(i)) TO '{folder}/events.parquet'"
    )
    return con


@pytest.mark.parametrize("key", ["plan_routes", "apply_plan", "route_legs", "route_text", "plan_entropy_report", "plan_histograms"])
def test_a_route_crosses_its_whole_zone(spark, tmp_dir, key):
    # One zone is one route, however many grid cells its stations lie in.
    from oracle import compare

    con = zone_tables(tmp_dir)
    for t in ("supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_dir}/{t}.parquet')")
    assert "LAT /" not in E.oracle_sql()[key]
    got = E.queries()[key](spark, tmp_dir).toPandas()
    ok, msg = compare(got, con.execute(E.oracle_sql()[key]).df())
    assert ok, msg
    if key in ("plan_routes", "route_legs"):
        assert set(got.ZONE) == {"00007"} and len(got) == 23
    if key == "route_text":
        assert len(got) == 1 and len(got.TEXT[0].splitlines()) == 24


def plain_walk(n=24):
    """The reference's loop over the stations of ``zone_tables``: legs, and (bikes, docks) per station before and after."""
    at = {i: ((413500 + i * 37 % 1000) / 1e4, (21000 + i * 91 % 1000) / 1e4) for i in range(n)}
    cap = {i: 20 + i for i in range(n)}
    before = {i: (i * 5 % 23, i * 7 % 13) for i in range(n)}
    need = {i: round(cap[i] * 0.45 - before[i][0]) for i in range(n)}
    here, load, legs, after = min(need, key=lambda i: (min(need[i], 0), i)), 0, [], dict(before)
    left = set(at) - {here}
    while left:
        bikes, docks = before[here]
        amount = min(20 - load, -need[here], bikes) if need[here] < 0 else round(min(load, need[here], docks) / 1.7)
        moved = amount if need[here] < 0 else -amount
        load += moved
        after[here] = (bikes - moved, docks + moved)
        there = min(left, key=lambda i: (math.dist(at[i], at[here]), i))
        legs.append((here, there, f"{'Picked up' if need[here] < 0 else 'Dropped off'} {amount} bikes"))
        left.remove(there)
        here = there
    return legs, cap, before, after


def planned(spark, folder, key):
    zone_tables(folder)
    return E.queries()[key](spark, folder)


def test_apply_plan_serves_the_whole_zone(spark, tmp_dir):
    got = {r.STATION_ID: (r.NUM_BIKES_AVAILABLE, r.NUM_DOCKS_AVAILABLE) for r in planned(spark, tmp_dir, "apply_plan").collect()}
    assert got == plain_walk()[3]


def test_route_legs_are_one_chain_through_the_zone(spark, tmp_dir):
    got = planned(spark, tmp_dir, "route_legs").orderBy("ZONE", "LEG_NO").collect()
    assert [(r.FROM_ID, r.TO_ID, r.ACTION) for r in got] == plain_walk()[0]


def test_route_text_tells_every_leg_of_the_zone(spark, tmp_dir):
    lines = [f"Bus {action}, then moved from Station {a} to Station {b}." for a, b, action in plain_walk()[0]]
    assert [r.TEXT for r in planned(spark, tmp_dir, "route_text").collect()] == ["\n".join([balance.PLAN_HEADER, *lines, ""])]


def test_plan_entropy_report_sums_over_the_whole_zone(spark, tmp_dir):
    def entropy(counts):
        ratios = [counts[i][0] / cap[i] for i in cap]
        return sum(-r * math.log2(r) - (1 - r) * math.log2(1 - r) for r in ratios if 0 < r < 1)

    _, cap, before, after = plain_walk()
    got = planned(spark, tmp_dir, "plan_entropy_report").first()
    # Ratios before the plan have four decimals.
    assert got.INITIAL_ENTROPY == pytest.approx(entropy(before), abs=0.01)
    assert got.FINAL_ENTROPY == pytest.approx(entropy(after), abs=1e-4)
