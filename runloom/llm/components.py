"""Connected components of a graph that lies in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import park


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (the smallest node of its component) for all nodes with edges `a`, `b`.

    Each round every node takes the smallest label among itself and its neighbours, then
    the label of that label, so labels travel twice as far each time. Only minima are
    aggregated; a node with very many edges is never gathered.
    """
    both = park(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = park(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.withColumnRenamed("root", "was").join(near, "node").withColumn("next", F.least("was", "near"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = park(
            step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("root")), "labels"
        )
        labels = moved.select("node", "root")
        if not moved.where("was <> root").limit(1).count():
            return labels
