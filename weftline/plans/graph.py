"""Connected components by rounds of least labels, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.stages import materialize


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node) of every node of a link. links: a, b; loops and repeats are fine, nulls are left out.

    Each round takes the least label of the neighbours and of the label's own node, so that long chains halve.
    Neighbours' labels are pre-aggregated before they are shuffled.
    """
    links = links.where("a is not null and b is not null")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "graph-edges")
    label = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "graph-labels")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l")).withColumnRenamed("a", "node")
        now = label.join(near, "node").select("node", F.least("label", "l").alias("new"), F.col("label").alias("old"))
        jump = now.select(F.col("node").alias("new"), F.col("new").alias("far"))
        now = now.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("label"), (F.coalesce("far", "new") != F.col("old")).alias("moved"))
        now = materialize(now, "graph-labels")
        label = now.select("node", "label")
        if not now.where("moved").limit(1).count():
            return label
