"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) long -> (cid, label): label is the smallest node reachable; linked nodes only.

    Each round a node takes the smallest label of itself and its neighbours (a partial
    aggregate, so a hub's links are summed up before the shuffle), then the label of its label.
    A component of diameter d needs about log d rounds. One small table is written a round."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc_edges")
    labels = materialize(edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc_labels")
    while True:
        near = edges.join(labels.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), "label").unionByName(labels)
        low = near.groupBy("cid").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("cid").alias("label"), F.col("label").alias("up"))
        moved = low.join(jump, "label", "left").select("cid", F.least("label", "up").alias("label"))
        new = materialize(moved, "cc_labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "cid").filter("label <> was").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(edges)
            return labels
