"""The content address of a table: a Merkle tree over its rows, whatever their order and files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from corvane.functions.ids import sha

#: Children of a node above the rows, as hexadecimal digits of their hash, and rows below a lowest node, about.
DIGITS, FANOUT = 2, 256
#: The address of a table without rows.
EMPTY = "0" * 64


def rows_hashed(rows: DataFrame) -> DataFrame:
    """name, hash: of each different row the hash of its values by name of column, and that with the number of such rows."""
    leaf = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    return rows.select(leaf.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", sha(F.col("name"), F.col("n")).alias("hash"))


def tree(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """name, hash: the nodes whose names have digits hexadecimal digits; by default so many that a node has FANOUT rows."""
    leaves = rows_hashed(rows)
    if digits is None:
        n = leaves.count()
        digits = DIGITS * max(0, math.ceil(math.log(max(1, n / FANOUT), 16**DIGITS)))
    return above(leaves, digits)


def above(nodes: DataFrame, digits: int) -> DataFrame:
    """The nodes of one level higher, by the first digits of names. Names are hashes, so no node has far more children than another."""
    named = nodes.groupBy(F.substring("name", 1, digits).alias("up")).agg(F.array_sort(F.collect_list(F.struct("name", "hash"))).alias("below"))
    return named.select(F.col("up").alias("name"), F.sha2(F.concat_ws(",", F.transform("below", lambda b: F.concat_ws(":", b["name"], b["hash"]))), 256).alias("hash"))


def address(rows: DataFrame) -> str:
    """The root's hash. Equal rows in any order have the same, one row more or less or otherwise has another."""
    n = rows.count()
    digits = DIGITS * max(0, math.ceil(math.log(max(1, n / FANOUT), 16**DIGITS)))
    nodes = tree(rows, digits)
    while digits > 0:
        digits -= DIGITS
        nodes = above(nodes, digits)
    root = nodes.first()
    return root.hash if root else EMPTY


def differing(one: DataFrame, other: DataFrame, digits: int = DIGITS) -> DataFrame:
    """name: the nodes in which two tables differ, and so the ranges of row hashes to compare."""
    a, b = tree(one, digits).withColumnRenamed("hash", "a"), tree(other, digits).withColumnRenamed("hash", "b")
    return a.join(b, "name", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("name")
