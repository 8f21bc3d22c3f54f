"""Connected components of a graph in tables: hooking to smaller labels and pointer jumping.

Every node points to a label, at first itself. In a round each edge offers the
label of one end to the other end and to that end's label; the smallest offer
wins, and then every node takes its label's label. Offers are combined before
they are shuffled, so a label that many nodes share is no hot key; jumping
reads both sides from stored tables, where Spark splits a skewed side. Rounds
are logarithmic in practice, and each one is stored in the shared folder, so a
lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: the smallest node it reaches.

    Edges with a NULL end are left out; loops and repeated edges are harmless; no
    edges, no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut_lineage(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = cut_lineage(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while True:
        at = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        ends = both.join(at("u"), "u").join(at("v"), "v").where("root_u < root_v")
        offers = ends.select(F.explode(F.array("v", "root_v")).alias("node"), F.col("root_u").alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(best, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        hooked = cut_lineage(hooked, "hooked")
        target = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = hooked.join(target, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("changed"))
        labels = cut_lineage(jumped, "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
