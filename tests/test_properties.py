"""Property tests: column expressions and the histogram against plain-Python
statements of the same semantics, on generated inputs (one Spark job per example)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stationflow.functions import columns as C
from stationflow.operators import metrics

ratios = st.lists(
    st.one_of(st.none(), st.floats(min_value=-0.5, max_value=1.5, allow_nan=False), st.sampled_from([0.0, 0.4, 0.6, 1.0, 0.39, 0.61])),
    min_size=1,
    max_size=60,
)


def py_color(r, t=0.1):
    if r is None or math.isnan(r):
        return None
    lo, hi = 0.5 - t, 0.5 + t
    clamp = lambda v: min(max(int(v), 0), 255)  # noqa: E731  (int() truncates toward zero)
    if lo <= r <= hi:
        return "#00FF00"
    if r < lo:
        return "#{:02x}{:02x}{:02x}".format(0, clamp(255 * r / lo), clamp(255 * (lo - r) / lo))
    return "#{:02x}{:02x}{:02x}".format(clamp(255 * (r - hi) / lo), clamp(255 * (1 - (r - hi) / lo)), 0)


def py_entropy(r):
    if r is None:
        return None
    if r in (0.0, 1.0):
        return 0.0
    if 0 < r < 1:
        return -r * math.log2(r) - (1 - r) * math.log2(1 - r)
    return None


@settings(max_examples=15, deadline=None)
@given(ratios)
def test_color_and_entropy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "r double")
    rows = df.select("r", C.occupancy_color("r").alias("c"), C.binary_entropy("r").alias("e")).collect()
    for row in rows:
        assert row.c == py_color(row.r), row
        want = py_entropy(row.r)
        assert (row.e is None and want is None) or math.isclose(row.e, want, rel_tol=1e-12, abs_tol=1e-15), row


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40))
def test_need_is_half_even(spark, pairs):
    df = spark.createDataFrame(pairs, "cap long, bikes long")
    for r in df.select("cap", "bikes", C.bike_need("cap", "bikes").alias("n")).collect():
        assert r.n == float(np.rint(r.cap * 0.45 - r.bikes))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(min_value=-2.0, max_value=3.0, allow_nan=False), min_size=1, max_size=80), st.integers(1, 45))
def test_histogram_property(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = metrics.ratio_histogram(df, "x", bins).orderBy("BIN").collect()
    counts, edges = np.histogram(np.array(values), bins=bins)
    assert [r.COUNT for r in rows] == counts.tolist()
    assert sum(r.COUNT for r in rows) == len(values)
    assert [r.BIN_LO for r in rows] == edges[:-1].tolist()
