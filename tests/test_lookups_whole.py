"""Look-ups that count before they join, and give all that their SQL gives."""

import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, TABLES, duck  # noqa: F401  duck is a fixture
from test_whole import same_rows

from lodestack.operators import identify as I
from lodestack.operators import lookups as K
from lodestack.operators import search as S
from lodestack.plans import registry

here = pytest.mark.skipif(not TABLES, reason="no tables here")


def test_forms_of_a_name_come_from_one_key(spark):
    from lodestack.functions import labels as L

    df = spark.createDataFrame([("Llama-3-8B_Chat",), (None,)], "raw string").select(L.benchmark_variants(F.col("raw")).alias("v"))
    assert df._jdf.queryExecution().analyzed().toString().count("[_.]") == 1
    got = [r["v"] for r in df.collect()]
    assert got[0][:4] == ["llama-3-8b", "llama-3-8b-instruct", "llama-3-8b-chat", "llama-3-8b-base"] and got[1] == []


@here
def test_keys_of_hosts_are_not_broadcast(spark):
    plan = registry.queries()["join_hosted_on"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    entities = spark.createDataFrame([("hf-model--a--b", "a--b", "a", "b"), ("x", "y", None, "z")], "id string, slug string, author string, name string")
    hosts = spark.createDataFrame([("p", "A/B"), ("o", "a--b"), ("q", "z")], "provider string, model string")
    found = K.hosted_on(entities, hosts)
    assert [tuple(r) for r in found.collect()] == [("hf-model--a--b", ["o", "p"])]


def test_requests_meet_slugs_after_these_are_counted(spark):
    entities = spark.createDataFrame([(f"hf-model--s-{i}", "model", "s") for i in range(30)] + [("s", "paper", "other"), ("t", "tool", "t"), ("hf-space--u", "space", "v")], "id string, type string, slug string")
    requests = spark.createDataFrame([(1, "s", None), (2, "hf-model--S", None), (3, "t", None), (4, "hf-space--u", "tool"), (5, "none", None), (6, "hf-model--s", "paper"), (7, "v", None), (8, "t", "paper")], "req_no int, req string, route string")
    found = I.matched(requests, entities)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["req_no"]: tuple(r)[1:] for r in found.collect()}
    assert got == {1: ("FOUND", "s", 25), 2: ("AMBIGUOUS", None, 25), 3: ("FOUND", "t", 1), 4: ("NOT_FOUND", None, 1), 5: ("NOT_FOUND", None, 0), 6: ("NOT_FOUND", None, 25), 7: ("FOUND", "hf-space--u", 1), 8: ("NOT_FOUND", None, 1)}


def test_all_long_texts_of_a_paper_are_found(spark):
    pending = spark.createDataFrame([("p", "i"), ("p", "j"), ("q", "k"), (None, "l")], "paper string, id string")
    corpus = spark.createDataFrame([("p", "abcd"), ("p", "abcde"), ("p", "a"), ("r", "abcd"), (None, "abcd")], "paper string, text string")
    assert sorted(map(tuple, K.drain(pending, corpus, "paper", 4).collect())) == [("p", "i", 4), ("p", "i", 5), ("p", "j", 4), ("p", "j", 5)]


@here
def test_terms_without_a_row_in_the_first_chunk_of_a_block(spark, duck, monkeypatch):  # noqa: F811
    monkeypatch.setattr(S, "CHUNK_ROWS", 1)
    same_rows(spark, duck, "search_index")


@here
def test_matches_are_scored_before_profiles_meet_their_members(spark):
    plan = registry.queries()["match_score"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("levenshtein") > plan.index("Join")


@here
def test_relations_are_read_once_around_nodes(spark):
    plan = registry.queries()["join_around"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4
