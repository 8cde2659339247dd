"""Connected components by minimum labels and pointer jumping, on written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.spool import drop, spool


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); the label is the least node of its component. A spooled table."""
    both = spool(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = spool(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = spool(step.join(up, step.label == up.up).select("node", "was", F.least("label", "top").alias("label")), "labels")
        moved = not jumped.filter("was <> label").isEmpty()
        drop(labels)
        labels = jumped.select("node", "label")
        labels._spooled = jumped._spooled
        if not moved:
            drop(both)
            return labels
