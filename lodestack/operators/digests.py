"""Digests of sets that can be merged: sums of hashes by range of the hash, combined as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits that name a leaf: 65,536 ranges.
DEPTH = 4


def leaves(df: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """(prefix, n, low, high): of each range of MD5 values the number of distinct values and the sums of two parts of their MD5. Nulls don't count.

    The digest of a union of disjoint sets is the sum of theirs, so parts can be taken apart and put together; rows are 16**depth at most."""
    values = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct().select(F.md5("v").alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(38,0)"))
    return values.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), part(1).alias("low"), part(15).alias("high"))


def combined(tree: DataFrame, depth: int) -> DataFrame:
    """The digests of the ranges of shorter prefixes, from those of longer ones; depth 0 is the whole set."""
    return tree.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(*(F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in ("n", "low", "high")))


def set_digest(df: DataFrame, column: str) -> DataFrame:
    """One row (digest, n) of the distinct values of a column: SHA-256 of their number and the two sums."""
    whole = leaves(df, column).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "low", "high")))
    return whole.select(F.sha2(F.concat_ws(":", *(F.col(c).cast("decimal(38,0)").cast("string") for c in ("n", "low", "high"))), 256).alias("digest"), F.col("n").cast("long").alias("n"))


def drifted(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> tuple[list[str], list[int]]:
    """The prefixes whose digests differ between two tables of leaves, found from the root down, and how many ranges of each level were compared.

    A range is looked into only if its own digests differ, so equal sets take one comparison, and few differences few of them. The driver
    has the leaves, 16**depth at most, whatever the number of values."""
    trees = []
    for table in (a, b):
        tree: dict[str, tuple[int, int, int]] = {}
        for prefix, *sums in table.select("prefix", "n", "low", "high").collect():
            for level in range(depth + 1):
                tree[prefix[:level]] = tuple(map(sum, zip(tree.get(prefix[:level], (0, 0, 0)), map(int, sums), strict=True)))
        trees.append(tree)
    x, y = trees
    suspects, compared = [""], []
    for level in range(depth + 1):
        compared.append(len(suspects))
        suspects = [p for p in suspects if x.get(p) != y.get(p)]
        if level == depth or not suspects:
            break
        suspects = [q for p in suspects for q in (p + d for d in "0123456789abcdef") if q in x or q in y]
    return suspects, compared


def difference(a: DataFrame, b: DataFrame, column: str, depth: int = DEPTH) -> DataFrame:
    """(side, value): the distinct values that only a (left) or only b (right) has; only values of ranges that differ are compared."""
    prefixes, _ = drifted(leaves(a, column, depth), leaves(b, column, depth), depth)
    few = a.sparkSession.createDataFrame([(p,) for p in prefixes], "p string")  # 16**depth at most

    def of(df: DataFrame) -> DataFrame:
        values = df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
        return values.withColumn("p", F.substring(F.md5("value"), 1, depth)).join(F.broadcast(few), "p", "left_semi").drop("p")

    x, y = of(a), of(b)
    return x.subtract(y).select(F.lit("left").alias("side"), "value").unionByName(y.subtract(x).select(F.lit("right").alias("side"), "value"))
