"""Merging and deduplicating records of one entity, and keeping a keyed table up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order; nothing else of its group is kept or gathered."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def merge_records(old: DataFrame, new: DataFrame, key: str, greatest: Sequence[str] = (), union: Sequence[str] = (), trails: dict[str, int] | None = None) -> DataFrame:
    """Both tables by key: a new value wins, but the larger one of `greatest`, both sets of `union` in order, and the last entries of
    `trails`. Keys of either side stay; columns are those of old."""
    trails = trails or {}
    pairs = old.alias("o").join(new.alias("n"), key, "full_outer")
    out = [F.col(key)]
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == key:
            continue
        if c in greatest:
            out.append(F.greatest(a, b).alias(c))
        elif c in union:
            empty = F.array().cast(old.schema[c].dataType)
            out.append(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)).alias(c))
        elif c in trails:
            empty = F.array().cast(old.schema[c].dataType)
            both = F.concat(F.coalesce(a, empty), F.coalesce(b, empty))
            out.append(F.slice(both, F.greatest(F.size(both) - trails[c] + 1, F.lit(1)), trails[c]).alias(c))
        else:
            out.append(F.coalesce(b, a).alias(c))
    return pairs.select(*out)


def upsert(registry: DataFrame, batch: DataFrame, key: str, seen: str) -> DataFrame:
    """registry(key, status, last_seen, ...) after a batch: new and changed rows are active and seen now, others become stale."""
    out = registry.alias("o").join(batch.withColumn("_in", F.lit(True)).alias("n"), key, "full_outer")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in batch.columns if c != key]
    status = F.when(F.col("_in"), "active").otherwise("stale").alias("status")
    return out.select(key, *cols, status, F.when(F.col("_in"), F.lit(seen)).otherwise(F.col("o.last_seen")).alias("last_seen"))


def sum_by_id(df: DataFrame, key: str, sums: Sequence[str], union: Sequence[str], longest: Sequence[str]) -> DataFrame:
    """One row per key: sums, distinct union of arrays in order, longest text."""
    return df.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union), *(F.max_by(c, F.struct(F.length(c), F.col(c))).alias(c) for c in longest))


def fold(df: DataFrame, key: str, at: Column, greatest: Sequence[str] = (), union: Sequence[str] = ()) -> DataFrame:
    """Records of one key merged one after another in the order `at`, by the rules of merge_records: the last value that isn't null, the
    greatest of `greatest`, the set of `union` in order; `folded` counts them. Partly merged before they are shuffled."""
    kept = [c for c in df.columns if c not in {key, *greatest, *union}]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in kept]
    most = [F.max(c).alias(c) for c in greatest]
    one = df.withColumn("_at", at)
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union]
    return one.groupBy(key).agg(F.count("*").alias("folded"), *last, *most, *sets)


def latest_valid(df: DataFrame, key: str, stamp: str) -> DataFrame:
    """The row of the latest stamp that parses; one without any if none of its key has one."""
    return first_by(df.withColumn("_t", F.try_to_timestamp(stamp)), [key], [F.desc_nulls_last("_t")])


def ledger(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A refresh ledger(key, refresh_count, has_text, note) after a pass over `new`(key, has_text, note)."""
    both = old.alias("o").join(new.withColumn("_in", F.lit(1)).alias("n"), key, "full_outer")
    return both.select(key, (F.coalesce("o.refresh_count", F.lit(0)) + F.coalesce("n._in", F.lit(0))).alias("refresh_count"), F.greatest(F.coalesce("o.has_text", F.lit(0)), F.coalesce("n.has_text", F.lit(0))).alias("has_text"), F.coalesce("n.note", "o.note").alias("note"))
