"""Connected components of an edge table, by smallest labels and pointer jumping; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webskein.plans.staging import free, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of ``edges`` (a, b); comp is the smallest node reachable.

    A round takes the smallest label among neighbours and then the label of that label. Labels are written after each round,
    so that lineage stays short, and those of the round before are freed; a hub's rows combine before the shuffle."""
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("m"))
        least = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("above"))
        after = stage(least.join(up, F.col("comp") == F.col("up")).select("node", "old", F.least("comp", "above").alias("comp")), "labels")
        free(labels)
        if after.where("old <> comp").isEmpty():
            free(both)
            return after
        labels = after
