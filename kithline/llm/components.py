"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (a, b).

    Each round takes the smallest label among neighbours and then follows labels
    one step, so chains shrink by halves; every round is written to the shared
    folder. Nodes without edges are not in the result. Self loops are allowed.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges", narrow=True)
    labels = last = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels", narrow=True)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        moved = written(stepped.join(jump, F.col("next") == F.col("via")).select("node", F.least("next", "far").alias("next"), "component"), "labels", narrow=True)
        done = moved.where("next <> component").isEmpty()
        dropped(last)
        last = moved
        labels = moved.select("node", F.col("next").alias("component"))
        if done:
            dropped(both)
            return labels
