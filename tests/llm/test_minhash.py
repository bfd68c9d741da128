"""Operator 11 against a plain Python version of the same fingerprint, against exact Jaccard similarities, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import awkward, clashing, prose

from lodestack.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    """XXH64 of several values as Spark takes it: each hash is the seed of the next."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {(" ".join(words),)}


def brute(text):
    least = {}
    for s in shingles(text):
        h = chained(s)
        b = (h >> 56) + 128
        least[b] = min(h, least.get(b, h))
    out = []
    for b in range(256):
        home = next((j for j in [b, *minhash.probes(b)] if j in least), None)
        if home is None:
            home = min(least, key=lambda j: chained([np.int32(b), np.int64(j - 128)]))
        out.append(least[home] & 15)
    return "".join(f"{x:x}" for x in out)


def order(row):
    return (-(1 << 63) if row[0] is None else row[0], -((chained([row[1] or ""]) % (1 << 64)) >> 11))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def test_report_is_that_of_plain_python(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=order, reverse=True)
    want = Counter()
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, b, c = brute(t), brute(edited), brute(after)
        near = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 256 - 1 / 16) / (15 / 16))
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9))] += 1
    got = minhash.report(clashing(docs)).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, f"text {i}", None, None, None) for i in range(rows)], SCHEMA)
    got = {r["doc_id"]: r["next_text"] for r in minhash.followed(df, ["text"]).collect()}
    assert got == {i: f"text {(i - 1) % rows}" for i in range(rows)}


def test_ranges_of_many_rows_and_of_one_hot_id(spark):
    """A third of the rows have one id; each row still has one follower, and the ids fall round the whole circle."""
    df = spark.range(3000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = minhash.followed(df, ["doc_id", "text"]).collect()
    assert Counter(r["text"] for r in got) == Counter(r["next_text"] for r in got) == Counter(f"t{i}" for i in range(3000))
    assert sum(r["next_doc_id"] > r["doc_id"] for r in got) == 1


def test_likeness_is_near_the_jaccard_similarity(spark):
    rng = random.Random(3)
    pairs, want = [], []
    for k in range(120):
        base = prose(rng, 400).split()
        other = base[: 4 * k % 400] + prose(rng, 400).split()[4 * k % 400 :]
        pairs.append((k, " ".join(base), " ".join(other)))
        a, b = shingles(pairs[-1][1]), shingles(pairs[-1][2])
        want.append(len(a & b) / len(a | b))
    df = minhash.with_fingerprint(minhash.with_fingerprint(spark.createDataFrame(pairs, "k int, a string, b string"), "a", "x"), "b", "y")
    got = [r["j"] for r in df.select("k", minhash.likeness(F.col("x"), F.col("y")).alias("j")).orderBy("k").collect()]
    errors = np.array(got) - np.array(want)
    assert abs(errors.mean()) < 0.015 and errors.std() < 0.045


def test_equal_without_words_and_case(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n\t ",), ("Red Fox",), ("red  fox",)], "text string")
    a, b, c, d, e = (r["f"] for r in minhash.with_fingerprint(df, "text", "fp").select(minhash.digits(F.col("fp")).alias("f")).collect())
    assert a == b == c != d == e and len(a) == 256
