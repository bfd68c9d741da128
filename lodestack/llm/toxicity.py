"""Operator 1, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, mod 2**bits, of its words, of pairs of neighbours and of pairs with one word
between them (lower case, letters only). Each coordinate has its own learning rate, alpha / (beta + sqrt(sum of squared
gradients)), and an L1 penalty that leaves most weights at exactly zero; the rest, at most 2**bits floats, are broadcast.

The model is fitted in one task on a bounded sample: `per_class` rows of either label at most. A score of one half thus
means even odds between the labels as sampled, which favours catching the rarer one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.textkit import BLOCK_BYTES, arrow_map, blocks, held_out, lower_letters, mix, table, utf8, word_hashes

#: Bound of the training sample, in rows per label.
PER_CLASS = 4000
BITS = 20


@dataclass
class Weights:
    w: np.ndarray  # float32, 2**bits
    bias: float


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, bigram and skip-gram of rows of UTF-8 bytes; repeats included."""
    h, row = word_hashes(lower_letters(data), off)
    rows, feats = [row], [h]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                rows.append(row[gap:][same])
                feats.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_features(data: np.ndarray, off: np.ndarray, bits: int, limit: int = BLOCK_BYTES, on: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, both) of blocks of rows [i, j): the different pairs of a row of the block and a feature, as row << bits | feature, in order; of
    the features that are `on` where that is given.

    A row of over `limit` bytes is worked on in pieces that end between words and begin two words early, so that each pair and skip-pair lies whole in a
    piece; only its features, 2**bits at most, are kept from one piece to the next."""
    for i, j in blocks(off, limit):
        own = data[off[i] : off[j]]
        if j - i > 1 or len(own) <= limit:
            row, feat = features(own, off[i : j + 1] - off[i], bits)
            if on is not None:
                few = on[feat]
                row, feat = row[few], feat[few]
            yield i, j, np.unique((row << bits) | feat)
            continue
        gaps = np.flatnonzero(lower_letters(own) == 32)
        both, begin, end = np.zeros(0, np.int64), 0, 0
        while end < len(own):
            at = np.searchsorted(gaps, end + limit)
            end = int(gaps[at]) + 1 if at < len(gaps) else len(own)
            _, feat = features(own[begin:end], np.array([0, end - begin]), bits)
            both = np.union1d(both, feat if on is None else feat[on[feat]])
            begin = _two_words_back(gaps, end)
        yield i, j, both


def _two_words_back(gaps: np.ndarray, end: int) -> int:
    """Where the second last word before `end` begins, by the places between words."""
    for _ in range(2):
        at = int(np.searchsorted(gaps, end)) - 1
        while at >= 0 and gaps[at] == end - 1:  # what stands between this word and the next
            end, at = end - 1, at - 1
        end = int(gaps[at]) + 1 if at >= 0 else 0
    return end


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, bits: int) -> DataFrame:
    """(doc_id, features f, label y) of at most per_class rows of either label that are not held out.

    A document whose labels disagree counts as toxic; null labels and ids never count."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y")).filter(~held_out()).withColumn("y", (F.col("y") == 1).cast("int"))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])  # 2 * per_class rows
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = utf8(b.column("text"))
        y = b.column("y")
        for i, j, both in distinct_features(data, off, bits):
            starts = np.searchsorted(both >> bits, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), lists, y.slice(i, j - i)], ["doc_id", "f", "y"])

    hashed = arrow_map(rows, each, "doc_id long, f array<int>, y int")
    # ids may repeat in docs, so the bound is set again
    return hashed.orderBy(F.xxhash64("doc_id", "f"), "doc_id").limit(2 * per_class)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and intercept after `epochs` passes over (features, label); the intercept has no L1 penalty."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= penalty[at], 0.0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            feats, y = rows[k]
            at = np.append(feats, size)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5, epochs: int = 5) -> Weights:
    """Without any training row all scores are 0.5, or what the prior of the only label gives."""
    rows = training_rows(docs, labels, per_class, bits)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(np.asarray(f, np.int64), int(y)) for b in batches for f, y in zip(b["f"], b["y"], strict=True)]
        w, bias = ftrl(got, bits, alpha, beta, l1, l2, epochs)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at].astype(float), bias)})

    got = rows.coalesce(1).mapInPandas(train, "at long, w double").toPandas()
    w, bias = np.zeros(1 << bits, np.float32), 0.0
    for at, x in zip(got["at"], got["w"], strict=True):
        if at < 0:
            bias += x
        else:
            w[at] = x
    return Weights(w, bias)


def score_column(model: Weights, column: pa.Array) -> np.ndarray:
    data, off = utf8(column)
    bits = int(np.log2(len(model.w)))
    total = np.zeros(len(off) - 1)
    for i, j, both in distinct_features(data, off, bits, on=model.w != 0):
        total[i:j] = np.bincount(both >> bits, weights=model.w[both & ((1 << bits) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -60, 60)))


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    A null or empty text, or one without a letter, scores what the intercept alone gives. Repeated rows give repeated results,
    an empty table none; only doc_id and text are read, so other columns may have any name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats: a fixed size

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        s = score_column(shared.value, b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select("doc_id", held_out().alias("held"), "text"), each, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
