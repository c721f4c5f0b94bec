"""Connected components of verified links, by label spreading with shortcuts, in DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node in links(a, b); component is its smallest reachable node.

    Each round gives a node the smallest label among itself and its neighbours, then follows that label once, so the
    rounds needed grow with the logarithm of the longest path for the star-like links that verification leaves. Every
    round is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        new = saved(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("component")), f"{name}-labels")
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
