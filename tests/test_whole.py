"""Queries that do the whole job: with small blocks, against brute force, and recall."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, TABLES, duck, table  # noqa: F401  duck is a fixture

from lodestack.functions import text as X
from lodestack.operators import matching
from lodestack.plans import registry
from lodestack.plans.duck import ENT

here = pytest.mark.skipif(not TABLES, reason="no tables here")


def same_rows(spark, duck, name):  # noqa: F811
    sql = registry.oracle_sql()[name]
    got, want = registry.queries()[name](spark, DATA), duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), want.columns)


@here
@pytest.mark.parametrize("rows", [matching.PIECE_ROWS, 3])
def test_match_score_compares_all_of_a_category(spark, duck, monkeypatch, rows):  # noqa: F811
    monkeypatch.setattr(matching, "PIECE_ROWS", rows)
    same_rows(spark, duck, "match_score")


@here
@pytest.mark.parametrize("rows", [matching.PIECE_ROWS, 3])
def test_rule_similarity_scores_all_of_a_category(spark, duck, monkeypatch, rows):  # noqa: F811
    monkeypatch.setattr(matching, "PIECE_ROWS", rows)
    same_rows(spark, duck, "join_rule_similarity")


@here
def test_recommend_has_all_terms_and_targets(spark, duck):  # noqa: F811
    ents = duck.sql(f"WITH {ENT} SELECT k, id, tags, pipeline_tag, author, coalesce(likes, 0), date_diff('day', last_modified, DATE '2024-02-01') FROM ent").fetchall()
    want = {}
    for k, target, tags, tag, author, likes, _ in ents:
        if k % 50:
            continue
        found = []
        for j, id, tags2, tag2, author2, likes2, days in ents:
            most = max(likes, likes2)
            ratio = min(likes, likes2) / most if most else 0.5
            age = 0.5 if days is None else next((s for limit, s in ((30, 1.0), (90, 0.8), (180, 0.6), (365, 0.4)) if days < limit), 0.3)
            s = 0.4 * len({*tags} & {*tags2}) / len({*tags} | {*tags2}) + 0.25 * (tag is not None and tag == tag2) + 0.15 * (author is not None and author == author2) + 0.1 * ratio + 0.1 * age
            if j != k and s > 0.2:
                found.append((-s, id))
        want[target] = [-s for s, _ in sorted(found)[:6]]
    got = defaultdict(list)
    for r in registry.queries()["join_recommend"](spark, DATA).collect():
        got[r["target"]].append(r["similarity"])
    assert len(want) > 1 and got.keys() == {t for t in want if want[t]}
    assert all(sorted(got[t], reverse=True) == pytest.approx(want[t], abs=2e-6) for t in got)


def vectors(duck):  # noqa: F811
    rows = duck.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)


@here
def test_nearest_of_all_queries(spark, duck):  # noqa: F811
    ids, _, x = vectors(duck)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(list)
    for r in registry.queries()["vector_nearest"](spark, DATA).collect():
        got[r["query"]].append(r["similarity"])
    assert sorted(got) == sorted(ids[ids % 50 == 0].tolist())
    for q, found in got.items():
        want = sorted(unit @ unit[ids == q][0], reverse=True)[:20]
        assert sorted(found, reverse=True) == pytest.approx(want, abs=2e-6)


@here
def test_product_codes_recall(spark, duck):  # noqa: F811
    ids, _, x = vectors(duck)
    got = defaultdict(dict)
    for r in registry.queries()["vector_product_codes"](spark, DATA).collect():
        got[r["query"]][r["vec_id"]] = r["distance"]
    assert sorted(got) == sorted(ids[ids % 50 == 0].tolist())
    recall = []
    for q, found in got.items():
        exact = ((x - x[ids == q]) ** 2).sum(axis=1)
        assert len(found) == 20 and all(d == pytest.approx(exact[ids == v][0], abs=1e-5) for v, d in found.items())
        recall.append(len({*ids[np.lexsort((ids, exact))[:20]].tolist()} & {*found}) / 20)
    print("recall", np.mean(recall))
    assert np.mean(recall) >= 0.9


@here
def test_rerank_and_clusters_take_all(spark, duck):  # noqa: F811
    ids, labels, x = vectors(duck)
    got = defaultdict(set)
    for r in registry.queries()["vector_rerank"](spark, DATA).collect():
        got[r["query"]].add((r["vec_id"], r["label"]))
    assert sorted(got) == sorted(ids[ids % 50 == 0].tolist())
    cents = {c: x[labels == c].mean(axis=0) for c in set(labels.tolist())}
    for q, found in got.items():
        v = x[ids == q][0]
        near = sorted(cents, key=lambda c: (-(cents[c] @ v) / np.linalg.norm(cents[c]) / np.linalg.norm(v), c))[:3]
        assert found == {(i, c) for c in near for i in sorted(ids[labels == c].tolist(), reverse=True)[:200]}
    clusters = registry.queries()["vector_clusters"](spark, DATA).collect()
    assert len(clusters) == len(ids) and len({r["cluster"] for r in clusters}) > 64


def test_main_content_reads_whole_pages(spark):
    html = "<p>" + "word " * 401_000 + "</p><p>last</p>"
    assert len(html) > 2_000_000
    got = spark.createDataFrame([(html,)], "html string").select(X.main_content(F.col("html")).alias("t")).first()["t"]
    assert got.endswith("last")
