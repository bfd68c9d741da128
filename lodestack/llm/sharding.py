"""Operator 7, sharding: a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0 to N-1 in the order of their contents, so the numbers don't depend on files or partitions. A balanced
Feistel network permutes the smallest domain of an even number of bits that holds N; what falls outside N is permuted again
until it falls inside, which makes a permutation of exactly N numbers. Place p is slot p // shards of shard p % shards: shard
sizes differ by one row at most, and shard and slot of any row number follow from key, N and the number of shards alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.textkit import materialise, mix, table

SHARDS = 24
ROUNDS = 6
KEY = 0x5EED


def permute(row: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The places of row numbers below n: a bijection of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = row.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """rows with `row`, their number in the order of the columns `by` (nulls first, equal rows in any order), and how many they are."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the last key splits rows that are equal in all others, however many
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, *by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    local = materialise(ordered.withColumn("local", F.monotonically_increasing_id()), "numbered")  # partition << 33 | number in it
    part = F.shiftright("local", 33)
    counts = sorted((r["part"], r["n"]) for r in local.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts, "part long, start long")
    joined = local.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("row", F.col("start") + F.col("local").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "local"), total


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text).

    A null text has no bytes: size 8, crc 0. Rows that repeat are numbered one after another, each with a place of its own; an
    empty table gives no rows; only doc_id and text are read, so other columns may have any name. The law is `rows`."""
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(light, ["doc_id", "text_crc32", "size"])

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(permute(b.to_numpy(), n, key))

    at = F.pandas_udf(place, "long")
    placed = rows.withColumn("place", at("row"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
