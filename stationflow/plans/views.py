"""Named SQL views over the operators (A13), so the dashboard-style SQL runs as is:

    register_views(spark, master, state, pair_radius_m=1500.0)
    spark.sql("SELECT * FROM broken_docks WHERE BROKEN_DOCKS > 1 ORDER BY BROKEN_DOCKS DESC LIMIT 10")

Views are lazy: each query re-plans the operator under Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import docks, geo


def register_views(
    spark: SparkSession,
    master: DataFrame,
    state: DataFrame,
    pair_radius_m: float,
    prefix: str = "",
) -> list[str]:
    """Create temp views ``<prefix>stations``, ``<prefix>current_state``,
    ``<prefix>broken_docks`` and ``<prefix>station_pairs`` (pairs within
    ``pair_radius_m`` metres, which the caller has to name); returns their names."""
    views = {
        f"{prefix}stations": master,
        f"{prefix}current_state": state,
        f"{prefix}broken_docks": docks.broken_docks(master, state),
        f"{prefix}station_pairs": geo.pairs_within(master, pair_radius_m),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
