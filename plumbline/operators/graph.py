"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) of every node on an edge; a component is its smallest node.

    Each round takes the least label among a node's neighbours and then that
    label's own label, so chains shorten geometrically.  Rounds are written to
    the shared folder; only the number of changes reaches the driver.  Their files are
    far smaller than their rows, so the joins are told to shuffle.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = written(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), labels["node"] == near["u"]).select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        moved = written(step.join(jump.hint("merge"), "least").select("node", F.col("label").alias("old"), F.least("least", "further").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def hub_components(ties: DataFrame, node: str = "node", hub: str = "hub") -> DataFrame:
    """(node, component) of nodes tied to hubs, where each hub is tied to itself; a component is its smallest hub.

    The least of a node's hubs stands for the node and is tied to its other hubs, so
    the rounds run on distinct pairs of hubs: however often the nodes of a large
    group are tied to the same hubs, a pair of them is one edge.
    """
    own = ties.select(F.col(node).alias("node"), F.col(hub).alias("hub")).distinct()
    least = written(own.withColumn("least", F.min("hub").over(Window.partitionBy("node"))), "hubs")
    found = connected_components(least.select("least", "hub").where("least <> hub").distinct(), "least", "hub").withColumnRenamed("node", "least")
    return least.select("node", "least").distinct().join(found.hint("merge"), "least", "left").select("node", F.coalesce("component", "least").alias("component"))
