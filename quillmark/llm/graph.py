"""Connected components by label joins: no node's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) of longs -> (node, component): the smallest node reachable, for each node that has a link.

    Each round takes the least label among a node's neighbours and then follows labels once (pointer jumping),
    so the number of rounds grows with the logarithm of a component's diameter.  Every round is written to the
    shared folder.  Self-links give a component of one; repeated links and nulls change nothing.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    edges = K.stored(links.union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = K.stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-0")
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        hop = labels.select(F.col("node").alias("over"), F.col("component").alias("jump"))
        nxt = (
            labels.withColumnRenamed("component", "was").join(seen, "node").withColumn("over", F.least("was", "least"))
            .join(hop, "over").select("node", "was", F.least("over", "jump").alias("component"))
        )
        nxt = K.stored(nxt, f"{name}-round")
        labels = nxt.select("node", "component")
        if not nxt.where("was <> component").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """labels (node, component) of some links, brought up to date with more links (a, b).

    The new links are contracted to links between components first, so only what they join is worked on again, and
    links within a component cost no round.  The result equals components() of all links together, but that a node with
    no link other than to itself gets no row.
    """
    own = labels.select(F.col("node"), F.col("component"))
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    for c in ("a", "b"):
        ends = ends.join(own.select(F.col("node").alias(c), F.col("component").alias("label_")), c, "left").withColumn(c, F.coalesce("label_", c)).drop("label_")
    between = K.stored(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-between")
    if not between.limit(1).count():
        return labels
    up = components(between, name)
    moved = own.join(up.select(F.col("node").alias("component"), F.col("component").alias("to_")), "component", "left")
    moved = moved.select("node", F.coalesce("to_", "component").alias("component"))
    return K.stored(moved.unionByName(up.join(own, "node", "left_anti").select("node", "component")), f"{name}-labels")
