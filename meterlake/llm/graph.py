"""Connected components by alternating stars, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges are (a, b) with a > b; so are the new ones.

    Large: every neighbour above a node is linked to the least node around it.
    Small: every neighbour not above it is. Both take the least neighbour by a
    partial aggregate, so a node with very many neighbours sends few rows.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        above = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        # every node keeps a link to its own least neighbour, too
        own = least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        new = above.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        new = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return new.unionByName(own).where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, the component being its least node.

    Edges may be repeated, in either direction, or lead to themselves. Each
    round writes its edges as a table, so that a lost executor costs one round
    at most; the number of rounds grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("m"))
    held = table(pairs.where("a > b").distinct(), "edges")
    told = None
    while True:
        mark = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == told:
            break
        told = mark
        after = table(_star(_star(held, True), False), "edges")
        forget(spark, held)
        held = after
    roots = held.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    ends = nodes.select("node").unionByName(nodes.select(F.col("m").alias("node"))).distinct()
    return ends.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
