"""Connected components by least labels with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b) -> (node, label): the least node reachable, for every node that has an edge.

    A round takes the least label among the neighbours and then the label of the label, so the rounds follow the
    logarithm of the diameter; a hub's rows are split by the adaptive skew join, and the sums combine before they move.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = scratch.save(both.distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        told = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        moved = scratch.save(nearer.join(jump, "next").select("node", F.least("next", "up").alias("label"), "old"), f"{name}-{turn}")
        changed = moved.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("node", "label")
        if not changed:
            return labels
