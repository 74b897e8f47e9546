"""Connected components of a link table: least neighbouring label, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node reachable.

    A round lowers every label to its neighbours' least and then to its label's label, so paths halve. Each round
    is written to the shared folder. A node with very many links is reduced before the shuffle, and the joins on it can be split.
    """
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select(F.col("b"), F.col("a"))).distinct()
    edges = cut(edges)
    labels = cut(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        lowered = labels.join(near, labels["node"] == near["src"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lowered = cut(lowered)
        up = lowered.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = cut(lowered.join(up, lowered["component"] == up["up"]).select("node", "was", F.least("component", "above").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.filter("component != was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
