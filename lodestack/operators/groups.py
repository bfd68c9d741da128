"""Groups of records that a greedy pass in a fixed order would make, in rounds over all records at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.containment import contained
from lodestack.operators.lookups import group_scores
from lodestack.sources.sinks import scratch


def greedy_groups(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, leader) for each id of pairs(a, b), which are symmetric: what a pass in the order of ids gives, in which an id that no leader before it
    is paired with becomes a leader, and others follow the first leader that they are paired with.

    In each round an undecided id becomes a leader if it has no undecided id before it among its pairs, and those paired with it follow; pairs of
    decided ids go, so what is left shrinks. Each round is written to the shared folder. Ids in many pairs are only ever minima of groups."""
    spark, folder = pairs.sparkSession, scratch(pairs.sparkSession, "groups")

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    open_ = keep(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links, leaders = open_, None
    nodes = keep(open_.select(F.col("a").alias("id")).union(open_.select(F.col("b").alias("id"))).distinct())
    left = nodes
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        behind = open_.select(F.col("b").alias("id")).distinct()
        new = keep(left.join(behind, "id", "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        followers = keep(open_.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        left = keep(left.join(new, "id", "left_anti").join(followers, "id", "left_anti"))
        decided = followers.unionByName(new)
        open_ = keep(open_.join(decided.withColumnRenamed("id", "a"), "a", "left_anti").join(decided.withColumnRenamed("id", "b"), "b", "left_anti"))
    else:
        raise RuntimeError(f"ids are still undecided after {max_rounds} rounds")
    if leaders is None:
        return nodes.select("id", F.col("id").alias("leader"))
    first = links.join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").join(leaders.withColumnRenamed("id", "b"), "b", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return first.unionByName(leaders.select("id", F.col("id").alias("leader")))


def platform_groups(models: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, leader) of each record of models(id, norm, author, params_billions, architecture) that is in a group of two or more.

    Two records are paired from a score of `least` on, which only names of which one holds the other can reach; these meet by n-grams. Records
    equal in all that is scored are one until the end, as they have the same pairs and one another."""
    key = ["norm", "author", "params_billions", "architecture"]
    profiles = models.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    bases = models.select("norm", F.element_at(F.split("norm", "/"), -1).alias("base")).distinct()
    names = bases.select(F.col("norm").alias("name")).union(bases.select(F.col("base").alias("name"))).distinct()
    held = contained(names, "name", names.withColumnRenamed("name", "text"), "text")
    whole = held.select(F.col("name").alias("short"), F.col("text").alias("long"))
    of_bases = held.join(bases.select(F.col("base").alias("name"), F.col("norm").alias("short")), "name").join(bases.select(F.col("base").alias("text"), F.col("norm").alias("long")), "text").select("short", "long")
    met = whole.unionByName(of_bases).distinct()
    x, y = profiles.select(F.col("norm").alias("short"), F.struct(*key, "id").alias("x")), profiles.select(F.col("norm").alias("long"), F.struct(*key, "id").alias("y"))
    scored = met.join(x, "short").join(y, "long").filter(F.col("x.id") != F.col("y.id")).withColumn("s", group_scores("x", "y")).filter(F.col("s") >= least)
    groups = greedy_groups(scored.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    placed = models.alias("m").join(profiles.withColumnRenamed("id", "first").alias("p"), same).select("m.id", "p.first", "p.n").join(groups.withColumnRenamed("id", "first"), "first", "left")
    several = placed.filter((F.col("n") > 1) | F.col("leader").isNotNull()).select("id", F.coalesce("leader", "first").alias("leader"))
    size = several.groupBy("leader").agg(F.count("*").alias("members")).filter("members > 1")
    return several.join(size, "leader").select("id", "leader")
