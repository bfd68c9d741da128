"""Joins to a table of one row a key whose keys may be very unequal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; there are at most its inverse of them.
HOT = 1 / 1000
#: Rows of a table none of whose keys can hold up a task for long.
FEW = 1_000_000


def look_up(left: DataFrame, key: str, right: DataFrame, how: str = "left", share: float = HOT, rows: int | None = None) -> DataFrame:
    """left joined by `key` to right, which has at most one row a key; both have that column. Tables of up to FEW `rows`, if that is told, join as they are.

    The rows of right for hot keys, 1/share at most, are broadcast, so the rows of left that have such a key stay where they are; the
    others meet by shuffle, and none of their keys can fill a task. left is read twice."""
    if rows is not None and rows <= FEW:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = left.agg(F.count("*").alias("total"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("total"))).select(key)
    mark = f"hot_{uuid.uuid4().hex[:8]}"
    marked = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    of_hot = right.join(F.broadcast(hot), key, "left_semi")
    warm = marked.filter(F.col(mark)).drop(mark).join(F.broadcast(of_hot), key, how)
    cold = marked.filter(F.col(mark).isNull()).drop(mark).join(right, key, how)
    return warm.unionByName(cold)
