"""Histogram against numpy.histogram, entropy report against pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from stationflow.operators import metrics


def hist(spark, values, bins=40):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return metrics.ratio_histogram(df, "x", bins).orderBy("BIN").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_histogram_matches_numpy(spark, seed):
    rnd = random.Random(seed)
    vals = [round(rnd.random() * 1.2, 4) for _ in range(500)] + [0.0, 1.2, 0.3, 0.6, 0.9]
    rows = hist(spark, vals + [None])
    counts, edges = np.histogram(np.array(vals), bins=40)
    assert [r.COUNT for r in rows] == counts.tolist()
    assert [r.BIN_LO for r in rows] == edges[:-1].tolist()
    assert [r.BIN_HI for r in rows] == edges[1:].tolist()


def test_histogram_edges_exactly(spark):
    # values sitting on bin edges of linspace(0, 1, 41)
    edges = np.linspace(0.0, 1.0, 41)
    vals = edges.tolist()
    rows = hist(spark, vals)
    counts, _ = np.histogram(np.array(vals), bins=40)
    assert [r.COUNT for r in rows] == counts.tolist()


def test_histogram_constant_column(spark):
    rows = hist(spark, [0.5, 0.5, 0.5])
    counts, edges = np.histogram(np.array([0.5, 0.5, 0.5]), bins=40)
    assert [r.COUNT for r in rows] == counts.tolist()
    assert rows[0].BIN_LO == 0.0 and rows[-1].BIN_HI == 1.0


def test_histogram_empty(spark):
    rows = hist(spark, [None, None])
    assert len(rows) == 40 and sum(r.COUNT for r in rows) == 0


def test_histogram_sum_is_non_null_rows(spark):
    vals = [0.1 * i for i in range(13)] + [None] * 3
    assert sum(r.COUNT for r in hist(spark, vals)) == 13


def ent(r):
    if r == 0 or r == 1:
        return 0.0
    with np.errstate(all="ignore"):
        return -r * np.log2(r) - (1 - r) * np.log2(1 - r)


def test_entropy_report(spark):
    before = [0.0, 0.25, 0.5, 1.0, 1.2, None, 0.7]
    after = [0.5, 0.5, 0.5, 0.9, 0.4, 0.3, None]
    df = spark.createDataFrame(list(zip(before, after)), "b double, a double")
    r = metrics.entropy_report(df, "b", "a").first()
    sb = pd.Series(before, dtype="float64").apply(ent).sum()
    sa = pd.Series(after, dtype="float64").apply(ent).sum()
    assert r.INITIAL_ENTROPY == round(sb, 4)
    assert r.FINAL_ENTROPY == round(sa, 4)
    assert math.isclose(r.ENTROPY_GAIN, round(sa - sb, 4))
    v = metrics.entropy_report_versions(
        df.selectExpr("b AS R"), df.selectExpr("a AS R"), "R"
    ).first()
    assert (v.INITIAL_ENTROPY, v.FINAL_ENTROPY) == (r.INITIAL_ENTROPY, r.FINAL_ENTROPY)
