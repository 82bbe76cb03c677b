"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import discard, staged, with_group


def components(edges: DataFrame) -> DataFrame:
    """id, label (smallest id that edges `a`, `b` reach) of every id on an edge.

    Each round takes the smallest label among neighbours and then the label of that label; a round halves the distances
    that are left. Only counts of changes reach the driver; labels and edges are written tables, so a lost executor
    does not lose a round. Minima are formed before rows move, so an id with very many neighbours is no burden.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().withColumnRenamed("a", "id"), "cc-edges")
    labels = staged(both.groupBy("id").agg(F.least("id", F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")), "cc-labels")
    while True:
        near = with_group(both, labels, "id", "degree").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", "degree", "label", F.least("label", "near").alias("least"))
        up = labels.select(F.col("id").alias("least"), F.col("label").alias("up"))
        after = staged(least.join(up, "least").select("id", "degree", F.least("least", "up").alias("label"), (F.least("least", "up") < F.col("label")).alias("moved")), "cc-labels")
        moved = after.filter("moved").limit(1).count()
        discard(labels)
        labels = after
        if not moved:
            discard(both)
            return labels.select("id", "label")
