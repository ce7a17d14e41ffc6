"""Connected components of an undirected graph given as edges, in rounds of joins.

Each round gives every node the least label among its neighbours' and its own, then follows the label of its label, which
halves long chains. Every round is written to the shared folder, so a lost executor costs one round at most. Only nodes
with edges take part; a round's shuffles carry one row per edge end. Labels only ever fall, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import materialize, release

def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for edges(a, b); self-loops keep single nodes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null and b is not null").distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        low = materialize(low, "cc-low")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(low.join(jump, "label", "left").select("node", "was", F.least("label", "next").alias("label")), "cc-labels")
        release(low)
        release(labels)
        labels = after.select("node", "label")
        if not after.filter("was <> label").limit(1).count():
            return labels
