"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.runtime import materialize


def _hook(edges: DataFrame, smaller: bool) -> DataFrame:
    """Link each node's neighbours to the least node among them and itself.

    With `smaller` only neighbours below the node move, otherwise only those above it; both keep
    the components. Minima are combined before the shuffle, so a node with very many links is
    no hot task.
    """
    if smaller:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.join(least, "u")
    if smaller:
        pairs = moved.select(F.col("v").alias("x"), "m").union(moved.select(F.col("u"), "m"))
    else:
        pairs = moved.filter("v > u").select(F.col("v").alias("x"), "m")
    return pairs.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (its least node) of every node of links (a, b), in few rounds of stars.

    Each round is written; rounds end when every node hangs on its least node.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    while True:
        new = materialize(_hook(_hook(edges, False), True), "links")
        tops = new.select(F.col("a").alias("node")).distinct()
        chains = tops.join(new.select(F.col("b").alias("node")), "node", "left_semi").isEmpty()
        double = new.groupBy("b").count().filter("count > 1").isEmpty()
        edges = new
        if chains and double:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select("a", "a").distinct()
    )
