"""Connected components of an edge list, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize


def components(edges: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(node, label): every node of ``edges`` (a long, b long) with the least node of its component.

    Each round takes the least label among the neighbours and then the label of that label, so labels move over a
    distance that doubles; each round is written to the scratch space. Nodes of any degree meet in partial aggregates
    only. While both directions of the edges are at most ``broadcast_rows``, labels go to the edges in place of a shuffle.
    Empty edges give an empty result; loops and repeated edges change nothing.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    written = labels
    sent = F.broadcast if both.count() <= broadcast_rows else (lambda df: df)
    while True:
        near = both.join(sent(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(sent(near), F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = materialize(step.join(sent(jump), F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        drop(written)
        written, labels = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            drop(both)
            return labels
