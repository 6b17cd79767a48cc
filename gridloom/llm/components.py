"""Connected components of an edge table, by min-label propagation with pointer jumping.

Labels live in tables of the shared folder, one per round; the driver only
sees whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the (a, b) edges; the label is the smallest node of its component."""
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links", small=True
    )
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels", small=True)
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        pulled = labels.join(least, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # jump: take the label of the label
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = pulled.join(root, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "old")
        step = materialise(jumped, "labels", small=True)
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
