"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import store



def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (u, v); the component is its least node.

    Every node points to the least label among itself and its neighbours, then to what that label
    points to, until nothing changes.  Labels are reduced before each shuffle, so a node with very
    many links is no more than a partial minimum per task.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    both, _ = store.compact(both.distinct())
    labels, _ = store.compact(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("component"))
    )
    # Labels grow with the links: they are shuffled, never collected by the driver to be sent.
    send = lambda df: df.hint("merge")
    while True:
        seen = (
            both.join(send(labels.select(F.col("node").alias("v"), "component")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("component").alias("seen"))
        )
        lower = seen.join(send(labels), "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped, _ = store.compact(
            lower.join(send(target), "component").select("node", "old", F.least("component", "next").alias("component"))
        )
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").limit(1).count() == 0:
            return labels
