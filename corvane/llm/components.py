"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import checkpointed, join_counted


def placed(node: str) -> Column:
    """Nodes in an order that has nothing to do with their values, so that long ordered chains shrink as fast as any."""
    return F.struct(F.xxhash64(node).alias("at"), F.col(node).alias("node"))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs, to node, root: the smallest node that can be reached.

    In each round every node that comes after one of its neighbours takes the first neighbour's first neighbour, and the
    links are drawn between what their ends took. A share of the nodes goes in each round, until no links are left. Joins on
    what many nodes share, a neighbour or a root, are safe for hot keys, so a giant component is no one task's.
    """
    links = checkpointed(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = checkpointed(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")))
    nodes, n = roots.count(), links.count()
    while n:
        both = links.union(links.select("b", "a"))
        nearest = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min(placed("b")).alias("first")).select("node", F.least("first", placed("node"))["node"].alias("to")))
        taken = checkpointed(join_counted(nearest, nearest.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", nodes).select("node", F.col("then").alias("to")))
        a, b = (taken.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = join_counted(checkpointed(join_counted(links, a, "a", n)), b, "b", n).select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        links = checkpointed(moved.filter("a <> b").distinct())
        roots = checkpointed(join_counted(roots, taken.select(F.col("node").alias("root"), "to"), "root", nodes, "left").select("node", F.coalesce("to", "root").alias("root")))
        n = links.count()
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return join_counted(roots, least, "root", nodes).select("node", F.col("least").alias("root"))
