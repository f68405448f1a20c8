"""Connected components by label propagation with pointer jumping; every step is a pair of shuffles, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, class_id) for every node of ``edges``; class_id is the smallest node of the component.

    Each round takes the least label among a node and its neighbours, then replaces labels by the label of their label,
    which halves the distance to the root; rounds are written to the shared folder and end when no label changes.
    An empty edge table gives an empty result; self-loops and repeated edges are harmless.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    both = materialize(both.distinct())
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = step.join(root, "label", "left").select("node", F.least("label", "above").alias("label"), "was")
        step = materialize(step)
        if step.where("label < was").limit(1).count() == 0:
            return step.select("node", F.col("label").alias("class_id"))
        labels = step.select("node", "label")
