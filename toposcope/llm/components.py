"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposcope.llm._shared import stash


#: up to so many edges the labels are broadcast, beyond they are shuffled
BROADCAST_EDGES = 1_000_000


def connected(links: DataFrame, path: str, most_rounds: int = 60, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """links (a, b) -> (node, label): label is the smallest node that can be reached.

    Each round takes the least label of the neighbours and then the label of the label,
    so a chain shortens by half and a star ends in two rounds.  Rounds are written out;
    nothing but an emptiness test comes to the driver.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    edges = stash(both.distinct(), f"{path}/edges")
    labels = stash(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")), f"{path}/labels0")
    side = F.broadcast if edges.count() <= broadcast_edges else (lambda df: df)
    for k in range(1, most_rounds):
        near = edges.join(side(labels.select(F.col("node").alias("src"), "label")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        step = near.join(side(labels), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = side(labels.select(F.col("node").alias("label"), F.col("label").alias("up")))
        new = stash(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), f"{path}/labels{k}")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def joined(labels: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """labels after further links: only components that the links touch are looked at."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    merged = connected(ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct(), path)
    known = labels.unionByName(merged.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    over = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return stash(known.join(over, "label", "left").select("node", F.coalesce("new", "label").alias("label")), f"{path}/joined")
