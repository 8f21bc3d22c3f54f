"""Broken docks: golden values of the reference sample and plan shape."""

from decimal import Decimal

from stationflow.operators import docks, status
from stationflow.schemas import MASTER

# The ids and counts of the sample; names and places are invented.
# (id, name, capacity, bikes, docks) chosen so capacity - (bikes + docks) gives the
# sample's seven values, plus stations that must not show: 1 broken (strict > 1),
# 0 broken, more usable than capacity, and a master station with no status.
GOLDEN = [
    (245, "Old Mill Road, 7", 30, 4, 3, 23),
    (455, "Harbour Lane, 5", 27, 2, 3, 22),
    (104, "Elm  Court", 24, 5, 3, 16),
    (86, "Café Square", 20, 10, 2, 8),
    (67, "Quay 3 | Ñandú Way", 25, 10, 10, 5),
    (510, "Hill Top, 37", 21, 6, 10, 5),
    (80, "Brook Row", 18, 3, 10, 5),
]
HIDDEN = [(1, "one broken", 20, 9, 10), (2, "full", 20, 10, 10), (3, "over", 20, 15, 10)]


def _frames(spark):
    master_rows = []
    status_rows = []
    for sid, name, cap, b, d, *_ in GOLDEN + [h + (None,) for h in HIDDEN]:
        master_rows.append((sid, name, None, Decimal("48.1234567"), Decimal("11.7654321"), None, name, "10001", cap, None, None, None, None, None))
        status_rows.append((sid, b, d, 1_700_000_000, 1))
    master_rows.append((999, "no status", None, Decimal("41.4"), Decimal("2.2"), None, "x", "10002", 30, None, None, None, None, None))
    master = spark.createDataFrame(master_rows, MASTER)
    st = spark.createDataFrame(
        status_rows, "STATION_ID long, NUM_BIKES_AVAILABLE long, NUM_DOCKS_AVAILABLE long, LAST_REPORTED long, TST_REC long"
    )
    return master, st


def test_golden_broken_docks(spark):
    master, st = _frames(spark)
    state = status.current_state(st, master)
    broken = docks.broken_docks(master, state)
    got = {r.STATION_ID: r.BROKEN_DOCKS for r in broken.collect()}
    assert got == {**{g[0]: g[5] for g in GOLDEN}, 1: 1}
    top = docks.top_broken_docks(broken).collect()
    assert [(r.STATION_ID, r.BROKEN_DOCKS) for r in top] == [
        (245, 23), (455, 22), (104, 16), (86, 8), (67, 5), (80, 5), (510, 5)
    ]
    assert top[0].STATION_NAME == "Old Mill Road, 7"
    assert [tuple(r) for r in docks.broken_docks_list(docks.top_broken_docks(broken, k=2)).collect()] == [
        ("Old Mill Road, 7", 23),
        ("Harbour Lane, 5", 22),
    ]


def test_plan_is_inner_join_and_top_k(spark):
    master, st = _frames(spark)
    df = docks.top_broken_docks(docks.broken_docks(master, status.current_state(st, master)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # master LEFT JOIN state + a NULL-rejecting filter plans as an inner join
    assert "Join Inner" in opt
    assert "PythonUDF" not in opt and "BatchEvalPython" not in plan


def test_sql_views(spark):
    from stationflow.plans.views import register_views

    master, st = _frames(spark)
    names = register_views(spark, master, status.current_state(st, master), pair_radius_m=1500.0, prefix="t_")
    assert names == ["t_stations", "t_current_state", "t_broken_docks", "t_station_pairs"]
    rows = spark.sql(
        "SELECT STATION_ID, BROKEN_DOCKS FROM t_broken_docks WHERE BROKEN_DOCKS > 1 "
        "ORDER BY BROKEN_DOCKS DESC, STATION_ID LIMIT 3"
    ).collect()
    assert [tuple(r) for r in rows] == [(245, 23), (455, 22), (104, 16)]
    # the 10 stations with status share one point (pairs at distance 0); station 999 is ~3 km away
    assert spark.sql("SELECT count(*) FROM t_station_pairs").first()[0] == 10 * 9 // 2
