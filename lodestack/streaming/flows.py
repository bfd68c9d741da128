"""Structured Streaming: windowed counts with a watermark, micro-batches into a registry, keyed state, deduplication.

Sources are Parquet files, a few a trigger. Each flow here runs what is available and returns the result as a table, which makes
it a query like any other; a service would leave the same query running."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestack.operators.rank import last_points
from lodestack.sources.sinks import scratch


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    return stream.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{table}.parquet") if _is_folder(spark, f"{sf_dir}/{table}.parquet") else stream.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(df: DataFrame, each, mode: str) -> None:
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type. The watermark lets state go; what a batch has changed replaces what was written before."""
    path = scratch(spark, "hourly")
    e = source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = e.withWatermark("ts", "40 days").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    _run(counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/batch={k}"), "update")
    written = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return written.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 2).alias("total"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refresh counts and last sight of each id. A batch writes its own sums under its number, so that a repeated batch replaces
    itself; the registry is the sum over batches."""
    path = scratch(spark, "registry")

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy("user_id").agg(F.count("*").alias("refreshes"), F.max("ts").alias("last_seen")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(source(spark, sf_dir, "events").select("user_id", "ts"), merge, "append")
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("refreshes").alias("refreshes"), F.max("last_seen").alias("last_seen"))


def last_scores(spark: SparkSession, sf_dir: str, keep: int = 90) -> DataFrame:
    """(user_id, points, latest): keyed state of the last `keep` scores of each id, those of a trigger in the order of their events."""
    path = scratch(spark, "state")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of a trigger only the last `keep` events can stay, so no more are held
        fresh = pd.DataFrame({"event_id": [], "value": []})
        for b in batches:
            fresh = pd.concat([fresh, b[["event_id", "value"]]]).nlargest(keep, "event_id")
        points = ((list(state.get[0]) if state.exists else []) + fresh.sort_values("event_id")["value"].tolist())[-keep:]
        state.update((points,))
        yield pd.DataFrame({"user_id": [key[0]], "points": [len(points)], "latest": [points[-1]]})

    flow = source(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, points int, latest double", "points array<double>", "update", GroupStateTimeout.NoTimeout)
    _run(flow, lambda b, k: b.write.mode("overwrite").parquet(f"{path}/batch={k}"), "update")
    return last_points(spark.read.option("basePath", path).parquet(path), "user_id", "batch", 1).select("user_id", "points", "latest")


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once by id, as many as there are ids."""
    path = scratch(spark, "once")
    once = source(spark, sf_dir, "events").select("event_id").dropDuplicates(["event_id"])
    _run(once, lambda b, k: b.write.mode("overwrite").parquet(f"{path}/batch={k}"), "append")
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
