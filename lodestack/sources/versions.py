"""Tables in versions that share what hasn't changed: rows in buckets by ranges of keys, a manifest a version, only changed buckets written."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.sinks import _fs

#: Buckets of a new table: a manifest has as many rows.
BUCKETS = 256
#: Keys of a sample for each bound, and rows and multiple of the mean beyond which a bucket is cut.
SAMPLE, CUT_ROWS, CUT_TIMES = 100, 100_000, 4


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The published versions, the oldest first: those whose manifest was written to its end."""
    fs, root = _fs(spark, f"{path}/manifests")
    if not fs.exists(root):
        return []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(path_of(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(bucket, version, n, digest) of a version, the last one unless told: in which version's files each bucket lies."""
    known = _numbers(spark, path)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version if version is not None else ''} under {path}")
    return spark.read.parquet(f"{path}/manifests/v{known[-1] if version is None else version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version; it stays what it is while later ones are written, until prune() lets it go."""
    entries = manifest(spark, path, version).filter("n > 0").select("bucket", "version").collect()  # BUCKETS rows at most
    schema = spark.read.parquet(f"{path}/schema").schema
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/v{r['version']}/rows/bucket={r['bucket']}" for r in entries))


def _digests(rows: DataFrame) -> DataFrame:
    """(bucket, n, digest): digests don't depend on the order of rows."""
    columns = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in rows.columns if c != "bucket"]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.concat_ws("-", *sums).alias("digest"))


def _bounds(rows: DataFrame, key: str, n: int, buckets: int) -> list:
    """Keys that cut n rows into about so many ranges of like size, by a sample of SAMPLE a range."""
    step = max(1, n // (SAMPLE * buckets))
    keys = sorted(r[0] for r in rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(key).collect())
    return sorted({keys[k * len(keys) // buckets] for k in range(1, buckets)}) if keys else []


def _bucket(key: str, table: list[tuple]) -> Column:
    """The bucket of a key by table (least key, bucket), in order; keys before the first one, and null, are in bucket 0."""
    lows = np.empty(len(table), object)
    lows[:] = [low for low, _ in table]
    numbers = np.array([0, *(b for _, b in table)])

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), np.int32)
        out[known] = numbers[np.searchsorted(lows, keys.to_numpy(object)[known], "right")]
        return pd.Series(out)

    return find(F.col(key))


def _table(spark: SparkSession, path: str, version: int) -> list[tuple]:
    fs, root = _fs(spark, f"{path}/bounds")
    found = max(v for v in (int(s.getPath().getName()[1:]) for s in fs.listStatus(root)) if v <= version)
    return [tuple(r) for r in spark.read.parquet(f"{path}/bounds/v{found}").orderBy("low").collect()]  # a row a bucket


def upsert(batch: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Write a version in which the rows of batch, one a key, replace those of their keys, and return its number; the last one's if nothing changes.

    Buckets are ranges of keys, so a batch of keys that lie together touches few of them however large the table is. Only the buckets of the
    batch's keys are read, and of these only those are written whose rows differ from what is there; one that outgrows the others by far is
    cut. The manifest is written last, so that a run that is lost leaves the last version as it is. The first batch makes the table, and
    fixes its columns and ranges."""
    spark = batch.sparkSession
    known = _numbers(spark, path)
    version = (known[-1] if known else 0) + 1
    folder = f"{path}/data/v{version}"
    if not known:
        batch.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
        before = spark.createDataFrame([], "bucket int, version int, n long, digest string")
        table = [(low, k + 1) for k, low in enumerate(_bounds(batch, key, batch.count(), buckets))]
        merged = batch.withColumn("bucket", _bucket(key, table))
    else:
        before, table = manifest(spark, path), _table(spark, path, known[-1])
        new = batch.withColumn("bucket", _bucket(key, table))
        touched = new.select("bucket").distinct()
        old = read(spark, path).withColumn("bucket", _bucket(key, table)).join(F.broadcast(touched), "bucket", "left_semi")  # a row a bucket
        merged = old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new.select(*new.columns))
    kind = merged.schema
    merged.write.mode("overwrite").parquet(f"{folder}/merged")
    merged = spark.read.schema(kind).parquet(f"{folder}/merged")
    sizes = {r["bucket"]: r["n"] for r in before.select("bucket", "n").collect()} | {r["bucket"]: r["count"] for r in merged.groupBy("bucket").count().collect()}  # a row a bucket
    mean = sum(sizes.values()) / max(1, len(sizes))
    cut, last = list(table), max([0, *(b for _, b in table)])
    for b, n in sorted(sizes.items()):
        if n > max(CUT_ROWS, CUT_TIMES * mean):
            inner = [low for low in _bounds(merged.filter(F.col("bucket") == b), key, n, int(n // max(mean, CUT_ROWS / CUT_TIMES))) if (low, b) not in table]
            cut += [(low, last + k + 1) for k, low in enumerate(inner)]
            last += len(inner)
    cut.sort()
    if cut != table or not known:
        spark.createDataFrame(cut, f"low {batch.schema[key].dataType.simpleString()}, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds/v{version}")
    if cut != table:
        merged = merged.withColumn("bucket", _bucket(key, cut))
    found = _digests(merged)
    changed = found.join(before.select("bucket", F.col("digest").alias("was")), "bucket", "left").filter("was IS NULL OR was <> digest").drop("was")
    changed.write.mode("overwrite").parquet(f"{folder}/changed")
    changed = spark.read.schema("bucket int, n long, digest string").parquet(f"{folder}/changed")
    fs, root = _fs(spark, folder)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if changed.isEmpty() and known:
        fs.delete(root, True)
        return known[-1]
    merged.join(F.broadcast(changed.select("bucket")), "bucket", "left_semi").repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")
    kept = before.join(changed.select("bucket"), "bucket", "left_anti").select("bucket", "version", "n", "digest")
    kept.unionByName(changed.select("bucket", F.lit(version).alias("version"), "n", "digest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/v{version}")
    fs.delete(path_of(root, "merged"), True)
    fs.delete(path_of(root, "changed"), True)
    return version


def prune(spark: SparkSession, path: str, keep: int = 3) -> list[int]:
    """Let all but the newest `keep` versions go, with those of their buckets that no kept version reads; the numbers of those gone."""
    known = _numbers(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    if not gone:
        return []
    used = reduce(DataFrame.unionByName, [manifest(spark, path, v).select("bucket", "version") for v in kept]).distinct().collect()  # keep * BUCKETS rows at most
    needed = {(r["version"], r["bucket"]) for r in used}
    fs, _ = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for v in known:
        rows = path_of(f"{path}/data/v{v}/rows")
        for s in fs.listStatus(rows) if fs.exists(rows) else []:
            name = s.getPath().getName()
            if name.startswith("bucket=") and (v, int(name.partition("=")[2])) not in needed:
                fs.delete(s.getPath(), True)
    for v in gone:
        fs.delete(path_of(f"{path}/manifests/v{v}"), True)
    return gone
