"""Network balance metrics.

Both are plain aggregations: the entropy report is one pass with conditional
sums, the histogram one pass for the bounds (skipped when bounds are given)
and one grouped count, joined to the list of all bins so empty bins show up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed value from the reference: number of histogram bins.
DEFAULT_BINS = 40


def entropy_report(df: DataFrame, before: Column | str, after: Column | str, digits: int = 4) -> DataFrame:
    """Sum of binary entropy before and after, and the gain.

    Ratios outside [0,1] or missing are skipped, as the reference's NaN-skipping
    sum does. Both sums come from one aggregation pass.
    """
    b = C.as_column(before)
    a = C.as_column(after)
    agg = df.agg(F.sum(C.binary_entropy(b)).alias("_b"), F.sum(C.binary_entropy(a)).alias("_a"))
    return _report(agg, digits)


def entropy_report_versions(before: DataFrame, after: DataFrame, ratio_col: str, digits: int = 4) -> DataFrame:
    """Entropy report over two versions of a table (e.g. two state snapshots).

    The versions are tagged and unioned, then summed conditionally: one
    aggregation, no join between the two.
    """
    tagged = before.select(F.lit(True).alias("_is_before"), F.col(ratio_col).alias("_r")).unionByName(
        after.select(F.lit(False).alias("_is_before"), F.col(ratio_col).alias("_r"))
    )
    e = C.binary_entropy("_r")
    agg = tagged.agg(
        F.sum(F.when(F.col("_is_before"), e)).alias("_b"),
        F.sum(F.when(~F.col("_is_before"), e)).alias("_a"),
    )
    return _report(agg, digits)


def _report(agg: DataFrame, digits: int) -> DataFrame:
    b = F.coalesce(F.col("_b"), F.lit(0.0))
    a = F.coalesce(F.col("_a"), F.lit(0.0))
    return agg.select(
        F.round(b, digits).alias("INITIAL_ENTROPY"),
        F.round(a, digits).alias("FINAL_ENTROPY"),
        F.round(a - b, digits).alias("ENTROPY_GAIN"),
    )


def histogram_bounds(df: DataFrame, col: Column | str) -> tuple[float, float] | None:
    """(min, max) of the non-missing values, or None when there are none."""
    v = C.finite(C.as_column(col).cast("double"))
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if row["lo"] is None:
        return None
    return float(row["lo"]), float(row["hi"])


def histogram_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``x`` over [lo, hi] with the last bin right-closed.

    Bin edges are lo + i * (hi - lo) / bins with the last edge exactly hi; the
    first guess is corrected against those edges, so a value sitting on an edge
    lands where an edge comparison puts it. A zero-width range is widened by
    0.5 on both sides. Values outside [lo, hi] give NULL.
    """
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    guess = ((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
    i0 = F.when(guess == bins, F.lit(bins - 1)).otherwise(guess)
    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((x >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1)
    return F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), i2)


def ratio_histogram(
    df: DataFrame,
    col: Column | str,
    bins: int = DEFAULT_BINS,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Counts per equal-width bin over the data's [min, max], empty bins included.

    Returns BIN, BIN_LO, BIN_HI, COUNT for bins 0..bins-1. Pass ``bounds`` to
    skip the min/max pass (e.g. (0.0, 1.0)).
    """
    spark = df.sparkSession
    x = C.finite(C.as_column(col).cast("double"))
    if bounds is None:
        bounds = histogram_bounds(df, x)
    if bounds is None:
        lo, hi = 0.0, 1.0
        counts = df.where(F.lit(False)).select(F.lit(0).alias("BIN"), F.lit(0).cast("bigint").alias("COUNT"))
    else:
        lo, hi = bounds
        counts = (
            df.select(histogram_bin(x, lo, hi, bins).alias("BIN"))
            .where(F.col("BIN").isNotNull())
            .groupBy("BIN")
            .agg(F.count(F.lit(1)).alias("COUNT"))
        )
    e_lo, e_hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    step = (e_hi - e_lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(e_hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(e_lo))

    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("BIN"))
    return all_bins.join(counts, "BIN", "left").select(
        "BIN",
        edge(F.col("BIN")).alias("BIN_LO"),
        edge(F.col("BIN") + 1).alias("BIN_HI"),
        F.coalesce(F.col("COUNT"), F.lit(0).cast("bigint")).alias("COUNT"),
    )
