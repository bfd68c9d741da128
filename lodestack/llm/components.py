"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.textkit import join_hot, materialise, release


def _star(directed: DataFrame, total: int, large: bool) -> DataFrame:
    """directed(u, v): for large, both directions of each edge; for small, from the larger end to the smaller."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
    joined = join_hot(directed, least, ["u"], "n", total)
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Each round writes its edges to the shared folder and deletes those of the last. No group is gathered: only minima are formed, and nodes with very many
    edges are joined by broadcast. Loops and null ends are left out; raises if max_rounds don't suffice."""
    now = materialise(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", light=True)
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = materialise(_star(both, 2 * state["n"], large=True), "large", light=True)
        before, now = now, materialise(_star(big, state["n"], large=False), "small", light=True)
        release(big, before)
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
