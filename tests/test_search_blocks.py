"""The stored index: blocks by score, exact answers from a part of it, the same with and without it."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.api import CANDIDATES, Catalogue
from lodestack.functions import text as X
from lodestack.operators import search as S


def test_blocks_cover_all_rows_once(spark):
    block, chunk = S.block_of(F.col("id"))
    rows = spark.range(300_000).select("id", block.alias("b"), chunk.alias("c")).groupBy("b").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("n"), F.max("c").alias("c")).orderBy("b").collect()
    assert rows[0]["a"] == 0 and all(x["z"] + 1 == y["a"] for x, y in zip(rows, rows[1:], strict=False)) and sum(r["n"] for r in rows) == 300_000
    assert rows[0]["n"] == 4 and rows[64]["n"] == 12 and len(rows) < 64 * 7 and max(r["c"] for r in rows) == 2
    far = spark.range(10**12, 10**12 + 2).select(*(c.alias(n) for c, n in zip(S.block_of(F.col("id")), "bc", strict=True))).first()
    assert far["b"] < 64 * 17 and far["c"] > 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(6)
    common = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for i in range(20_000):
        words = [w for w in common if rng.random() < 0.4] + [f"rare{rng.randint(0, 2000)}", "each"]
        rows.append((f"id{i:05d}", " ".join(words), None if i % 997 == 0 else rng.randint(0, 1000) / 10))
    df = spark.createDataFrame(rows, "id string, text string, score double").repartition(4)
    path = str(tmp_path_factory.mktemp("index"))
    S.write_index(df, "id", F.col("text"), "score", path)
    return df, path


@pytest.mark.parametrize(("query", "k", "most"), [("alpha beta gamma delta", 20, 0.1), ("each", 200, 0.05), ("rare7 alpha", 50, 1.0), ("alpha beta", 200, 0.2), ("each rare5 rare6", 20, 1.0), ("none", 5, 1.0)])
def test_pruned_search_is_the_exhaustive_one(spark, stored, query, k, most):
    df, path = stored
    wanted = X.terms_of(query)
    got, read = S.search_index(spark, path, "id", "score", wanted, k)
    want = S.search(S.inverted_index(df, "id", F.col("text"), "score"), "id", "score", wanted, k).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    print(query, read)
    assert read.postings <= most * read.of_postings and read.chunks <= read.of_chunks and read.rounds <= 8
    assert most == 1.0 or read.chunks < read.of_chunks


def test_same_rows_with_and_without_index_for_every_type(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"id{i:04d}", f"s{i}", " ".join(rng.choice(["blue", "red", "rod", "ring"]) for _ in range(3)), rng.choice(["model", "tool", "paper"]), float(rng.randint(0, 99))) for i in range(1500)]
    e = spark.createDataFrame(rows, "id string, slug string, name string, type string, score double")
    plain, stored = Catalogue(e), Catalogue(e)
    stored.build_index(str(tmp_path / "index"))
    for kind in (None, "tool", "paper", "gone"):
        a, b = (c.search("blue rods", type=kind, limit=50).select("id", "relevance", "hits").collect() for c in (plain, stored))
        assert a == b and (kind == "gone") == (not a)
    assert plain.search("blue", limit=50, page=CANDIDATES // 50 + 1).count() == 0


def test_terms_are_stems_of_words(spark):
    texts = ["Člověk őrült şahin", "élan naïve", "Relational models, running; a x 1b", None, "", "İstanbul straße", "no" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.terms(F.col("t")).alias("a"), X.stems(X.words(F.col("t"))).alias("b")).collect():
        assert r["a"] == r["b"]
    assert X.terms_of("Člověk őrült şahin élan") == ["clovek", "orult", "sahin", "elan"]
