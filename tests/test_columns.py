"""Hand-computed checks of the column library."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stationflow.functions import columns as C


def one(spark, expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_casts(spark):
    rows = [("16.5",), ("2.4",), ("abc",), (None,), ("7",)]
    assert one(spark, C.to_number("s"), rows, "s string") == [17, 2, None, None, 7]
    scaled = one(spark, C.to_number_scaled("s", 12, 2), rows, "s string")
    assert [None if v is None else float(v) for v in scaled] == [17.0, 2.0, None, None, 7.0]
    fixed = one(spark, C.to_fixed("s", 12, 7), [("48.12345678",), ("11.7654321",)], "s string")
    assert [str(v) for v in fixed] == ["48.1234568", "11.7654321"]
    assert one(spark, C.to_boolean("s"), [("true",), ("false",), ("x",)], "s string") == [True, False, None]


def test_json_text_field(spark):
    rows = [('{"k": 5, "a": {"b": "x"}}',), ('{"z": 1}',)]
    assert one(spark, C.json_text_field("j", "$.k"), rows, "j string") == ["5", None]
    assert one(spark, C.json_text_field("j", "$.a.b"), rows, "j string") == ["x", None]


def test_epoch_to_ntz_is_utc_wall_time(spark):
    got = one(spark, C.epoch_to_ntz("x"), [(1704103200,), (None,)], "x long")
    assert got == [dt.datetime(2024, 1, 1, 10, 0, 0), None]


def test_occupation_ratio(spark):
    rows = [(7, 27), (1, 3), (2, 3), (0, 20), (5, 0), (5, None), (24, 20)]
    got = one(spark, C.occupation_ratio("b", "c"), rows, "b long, c long")
    assert [None if v is None else str(v) for v in got] == ["0.2593", "0.3333", "0.6667", "0.0000", None, None, "1.2000"]


def test_occupation_ratio_double_rounding(spark):
    # 1/8 = 0.125 exactly: half-up at 4 decimals keeps 0.1250; 0.00005 boundary:
    # 1/20000 = 0.00005 -> 6 decimals 0.000050 -> 4 decimals 0.0001 (half-up)
    got = one(spark, C.occupation_ratio("b", "c"), [(1, 8), (1, 20000)], "b long, c long")
    assert [str(v) for v in got] == ["0.1250", "0.0001"]


def test_docks(spark):
    rows = [(30, 10, 15), (30, 10, 20), (30, None, 3)]
    assert one(spark, C.broken_docks("c", "b", "d"), rows, "c long, b long, d long") == [5, 0, None]


def test_binary_entropy(spark):
    rows = [(0.0,), (1.0,), (0.5,), (None,), (1.2,), (-0.1,), (0.25,), (float("nan"),)]
    got = one(spark, C.binary_entropy("r"), rows, "r double")
    assert got[:4] == [0.0, 0.0, 1.0, None]
    assert got[4] is None and got[5] is None
    assert math.isclose(got[6], -(0.25 * math.log2(0.25)) - 0.75 * math.log2(0.75))
    assert got[7] is None


@pytest.mark.parametrize(
    "ratio,color",
    [
        (0.4, "#00FF00"),
        (0.5, "#00FF00"),
        (0.6, "#00FF00"),
        (0.0, "#0000ff"),
        (0.39, "#00f806"),  # green int(255*0.39/0.4)=248, blue int(255*0.01/0.4)=6
        (0.61, "#06f800"),  # red int(255*0.01/0.4)=6, green int(255*(1-0.025))=248
        (1.0, "#ff0000"),
        (1.2, "#ff0000"),  # clamped: red 382 -> 255, green -127 -> 0
        (-0.1, "#0000ff"),  # clamped: green -63 -> 0, blue 318 -> 255
        (None, None),
        (float("nan"), None),
    ],
)
def test_occupancy_color(spark, ratio, color):
    assert one(spark, C.occupancy_color("r"), [(ratio,)], "r double") == [color]


def test_occupancy_color_threshold_guard():
    with pytest.raises(ValueError):
        C.occupancy_color("r", 0.5)


def test_bike_need_half_even(spark):
    # capacity*target - bikes: 2.5 -> 2, 3.5 -> 4, -0.5 -> -0, 1.5 -> 2
    rows = [(10, 2), (10, 1), (10, 5), (10, 3)]
    got = one(spark, C.bike_need("c", "b", 0.45), rows, "c long, b long")
    assert got == [2.0, 4.0, -0.0, 2.0]
    assert one(spark, C.bike_need("c", "b", 0.5), [(21, 8)], "c long, b long") == [2.0]  # 2.5 -> 2


def test_transfer_amounts(spark):
    rows = [(20.0, -7.0, 5)]
    assert one(spark, C.pickup_amount("f", "n", "b"), rows, "f double, n double, b long") == [5.0]
    assert one(spark, C.pickup_amount("f", "n", "b"), [(3.0, -7.0, 5)], "f double, n double, b long") == [3.0]
    # min(load, need, docks)/1.7: 4.25/1.7 = 2.5 -> 2 ; 5.95/1.7 = 3.5 -> 4 ; 0 -> 0
    got = one(spark, C.dropoff_amount("l", "n", "d"), [(4.25, 10.0, 9), (5.95, 10.0, 9), (0.0, 3.0, 2)], "l double, n double, d long")
    assert got == [2.0, 4.0, 0.0]


def test_distances(spark):
    # One degree of latitude on the mean sphere.
    got = one(spark, C.geo_distance_m("lo1", "la1", "lo2", "la2"), [(2.0, 41.0, 2.0, 42.0)], "lo1 double, la1 double, lo2 double, la2 double")
    assert math.isclose(got[0], math.radians(1.0) * C.EARTH_RADIUS_M, rel_tol=1e-12)
    got = one(spark, C.degree_distance("a", "b", "c", "d"), [(0.0, 0.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert got == [5.0]


def test_texts(spark):
    df = spark.createDataFrame([("pickup", 5, 1, 2, None, 7)], "k string, n int, a long, b long, name string, bikes long")
    r = df.select(
        C.refresh_message(F.lit(12)).alias("m"),
        C.action_text("k", "n").alias("t"),
        C.leg_text(C.action_text("k", "n"), "a", "b").alias("leg"),
        C.station_label("name", "bikes").alias("label"),
    ).first()
    assert r.m == "Processed 12 rows"
    assert r.t == "Picked up 5 bikes"
    assert r.leg == "Bus Picked up 5 bikes, then moved from Station 1 to Station 2."
    assert r.label == "Station ID: None - Bikes Available: 7"


def test_visited_ratio(spark):
    got = one(spark, C.visited_ratio("b", "c"), [(5, 20), (5, 0), (None, 3)], "b long, c long")
    assert got == [0.25, None, None]
