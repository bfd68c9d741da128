"""Ranking: percentiles, badges, top-N by group, pages, trends, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.sources.sinks import scratch


#: Different scores up to which one task adds them up; more of them are added up by ranges.
ONE_TASK = 100_000


def running_sum(df: DataFrame, order: Column, n: str, out: str) -> DataFrame:
    """df with the sum of `n` over all rows before each one in an order without ties; no task sees more than a range of it."""
    if df.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return df.withColumn(out, F.coalesce(F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    starts, total = [], 0
    for r in ranged.groupBy("_part").agg(F.sum(n).alias("n")).orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], total))
        total += r["n"]
    within = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(spark.createDataFrame(starts, "_part int, _start long")), "_part").withColumn(out, F.col("_start") + F.col("_within")).drop("_part", "_within", "_start")


def once(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read back: it is looked at several times, and what it comes from is read once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score_table(df: DataFrame, score: str) -> DataFrame:
    """(score, _ties, _above, _n): a row for each score that occurs, with the rows that have it, those that have a higher one, and all.

    Ranks of all rows follow from this table, which is as long as there are different scores; so the rows themselves are never
    sorted in one task. Scores of one decimal make at most a thousand."""
    counts = once(df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_ties")), "scores")
    total = counts.agg(F.coalesce(F.sum("_ties"), F.lit(0)).alias("_n"))
    return running_sum(counts, F.desc(score), "_ties", "_above").crossJoin(F.broadcast(total))  # one row


def midrank_percentile(df: DataFrame, score: str, out: str = "percentile") -> DataFrame:
    """1 to 100, the best near 100; equal scores share the middle of their ranks. Null scores get null."""
    table = score_table(df, score).withColumn(out, F.greatest(F.lit(1), F.floor((1 - (F.col("_above") + (F.col("_ties") - 1) / 2) / F.col("_n")) * 100 + 0.5)).cast("int"))
    return df.join(table.select(score, out), score, "left")


def competition_rank(df: DataFrame, score: str, out: str = "rank", total: str = "total") -> DataFrame:
    """1 for the best; equal scores share the best of their ranks."""
    return df.join(score_table(df, score).select(score, (F.col("_above") + 1).alias(out), F.col("_n").alias(total)), score, "left")


def badge(rank: Column, total: Column) -> Column:
    share = (total - rank) / total * 100
    out = F.lit("standard")
    for least, name in ((50, "top_50%"), (75, "top_25%"), (90, "top_10%"), (95, "top_5%"), (99, "top_1%"), (99.9, "top_0.1%")):
        out = F.when(share >= least, name).otherwise(out)
    return out


def thresholds(df: DataFrame, score: str, percents: Sequence[float]) -> DataFrame:
    """percent, threshold: the score at index floor(n * percent / 100) of the descending order, 0 where there is none."""
    table = score_table(df, score)
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in percents], "percent double")
    n = df.filter(F.col(score).isNotNull()).agg(F.count("*").alias("n"))
    at = wanted.crossJoin(n).withColumn("at", F.floor(F.col("n") * F.col("percent") / 100))  # a row per percent
    hit = (F.col("at") >= F.col("_above")) & (F.col("at") < F.col("_above") + F.col("_ties"))
    return at.join(table, hit, "left").select("percent", F.coalesce(score, F.lit(0.0)).alias("threshold"))


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark cuts each task's part to n before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(out) <= n)


def ranking_groups(df: DataFrame, category: str, type: str, order: Sequence[Column], n: int, page: int) -> DataFrame:
    """Top n of `all`, of each category and of each type, with rank and page."""
    labels = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("category:"), F.col(category)), F.concat(F.lit("type:"), F.col(type))))
    ranked = top_n(df.withColumn("grp", F.explode(labels)), ["grp"], order, n, "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / page) + 1)


def last_points(history: DataFrame, id: str, day: str, n: int) -> DataFrame:
    return top_n(history, [id], [F.desc(day)], n).drop("rn")


def trends(history: DataFrame, id: str, day: str, score: str, keep: int = 90) -> DataFrame:
    """One row per id with two points at least: latest, change in percent since the oldest kept point, direction, change since seven
    points ago, and the last seven scores."""
    points = F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), F.col(score).alias("score"))))
    rows = last_points(history, id, day, keep).groupBy(id).agg(points.alias("p")).filter(F.size("p") >= 2)
    value = lambda k: F.element_at("p", k)["score"]
    one = lambda x: F.floor(x * 10 + 0.5) / 10
    rows = rows.withColumn("latest", value(F.lit(-1))).withColumn("oldest", value(F.lit(1)))
    rows = rows.withColumn("change_window", F.when(F.col("oldest") > 0, one((F.col("latest") - F.col("oldest")) / F.col("oldest") * 100)).otherwise(0.0))
    week = F.when(F.size("p") >= 7, F.element_at("p", F.greatest(F.size("p") - 6, F.lit(1)))["score"]).otherwise(F.col("oldest"))
    rows = rows.withColumn("change_7d", one(F.col("latest") - week)).withColumn("direction", F.when(F.col("change_window") > 1, "up").when(F.col("change_window") < -1, "down").otherwise("stable"))
    return rows.select(id, F.size("p").alias("points"), "latest", "change_window", "direction", "change_7d", F.transform(F.slice("p", F.greatest(F.size("p") - 6, F.lit(1)), 7), lambda x: x["score"]).alias("scores"))


def order_statistics(df: DataFrame, score: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the score at index floor(n * share) of the ascending order, and max, zero share and n."""
    counts = once(df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("ties")), "scores")
    total = counts.agg(F.sum("ties").alias("n"))
    table = running_sum(counts, F.asc(score), "ties", "before").withColumn("upto", F.col("before") + F.col("ties")).crossJoin(F.broadcast(total))  # one row
    at = {k: F.least(F.floor(F.col("n") * q), F.col("n") - 1) for k, q in shares.items()}
    return table.agg(*(F.max(F.when((at[k] < F.col("upto")) & (at[k] >= F.col("upto") - F.col("ties")), F.col(score))).alias(k) for k in shares), F.max(score).alias("max"), (F.sum(F.when(F.col(score) == 0, F.col("ties")).otherwise(0)) / F.sum("ties")).alias("zero_share"), F.sum("ties").alias("n"))
