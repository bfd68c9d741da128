"""The best rows of each query by profiles, against all pairs in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, TABLES, duck  # noqa: F401  duck is a fixture
from test_whole import same_rows

from lodestack.operators import matching

here = pytest.mark.skipif(not TABLES, reason="no tables here")


@pytest.mark.parametrize("least", [None, 1.0])
def test_best_by_profile_are_the_best_of_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(matching, "PROFILE_QUERIES", 20)
    monkeypatch.setattr(matching, "PROFILE_ROWS", 40)
    monkeypatch.setattr(matching, "PROFILE_PAIRS", 64)
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", None]
    rows = [(f"r{i:03d}", rng.choice("xy") if i % 17 else None, [w for w in rng.sample(words, 3) if w] if i % 13 else None, rng.choice([1.0, 2.0, None]), rng.randint(0, 4) / 2) for i in range(300)]
    kinds = "id string, block string, tags array<string>, p double, plus double"
    df = spark.createDataFrame(rows, kinds)
    asked = df.filter("substr(id, 4, 1) IN ('0', '5')").select(F.col("id").alias("query"), "block", "tags", "p")
    base = lambda r, t, v: r.shared(t) + 0.5 * r.equal("p", v["p"])
    whole = lambda at, q, r: np.tile(at + r["plus"].to_numpy(), (len(q), 1))
    found = matching.best_by_profile(df, asked, "id", "query", "tags", ["p"], base, whole, lambda r: r["plus"].to_numpy(), 4, least=least, itself=("query", "id"), block="block").collect()
    want = []
    for q, b, t, p, _ in rows:
        if q[-1] in "05" and b is not None:
            scored = [(-(len(set(t or []) & set(u or [])) + 0.5 * (p is not None and p == o) + plus), i) for i, c, u, o, plus in rows if c == b and i != q]
            want += [(q, i, -s) for s, i in sorted(scored)[:4] if least is None or -s > least]
    assert sorted(map(tuple, found)) == sorted(want)


@here
@pytest.mark.parametrize("name", ["join_rule_similarity", "join_recommend", "join_shared_tags", "join_related"])
def test_queries_by_profile_in_small_tasks(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(matching, "PROFILE_QUERIES", 3)
    monkeypatch.setattr(matching, "PROFILE_ROWS", 30)
    same_rows(spark, duck, name)


@here
@pytest.mark.parametrize("name", ["join_rule_similarity", "join_recommend", "join_shared_tags", "join_related"])
def test_no_join_makes_all_pairs_of_rows(spark, name):
    """All pairs of queries and rows as rows of a plan: that was the time, and the disk of their sorts."""
    from lodestack.plans import registry

    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
