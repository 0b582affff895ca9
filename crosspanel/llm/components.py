"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round a node takes the least label among its neighbours' and then the label of that
    label; rounds go on until nothing changes. Null ends and loops are ignored.
    """
    good = links.where("a <> b")
    edges = written(good.select("a", "b").union(good.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        moved = written(low.join(jump, "low", "left").select("node", F.least("low", "lower").alias("new"), "component"), "components")
        labels = moved.select("node", F.col("new").alias("component"))
        if moved.where("new <> component").isEmpty():
            return labels
