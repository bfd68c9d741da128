"""The corpus pipeline: stages keep columns, take effect, and work on awkward tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_nearcopies import brute
from test_operators import SCHEMA, WORDS, awkward, brute_cut, clashing, prose
from tokenizers import Tokenizer

import corpus_pipeline
from lodestack.llm import language, quality
from lodestack.llm.textkit import live, materialise


def corpus():
    rng = random.Random(9)
    german = "der die und das ist nicht ein eine zu den von mit auf sich auch wird".split()
    rows = [(i, prose(rng, 120) if i % 2 else " ".join(rng.choice(german) for _ in range(120)), "en" if i % 2 else "de", "s", 0) for i in range(200)]
    rows += [(300, rows[1][1], "en", "s", 0), (301, "12 34 " * 60, None, "s", 0), (302, "short", "en", "s", 0), (303, " ".join(w + "&&&" for w in (WORDS * 8)), "en", "s", 0)]
    return rows


@pytest.mark.parametrize("rows", [corpus(), awkward(), []], ids=["corpus", "awkward", "empty"])
def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    names, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, "unused"), name)
        names.append(name)
        if name != "packing":
            assert docs.columns == columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        if rows and rows[0][0] == 0 and len(rows) > 150:
            left = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert 301 not in left
            assert name == "language" or not left & {302, 303}
            assert name in ("language", "quality") or 300 not in left
            assert len(left & set(range(200))) >= 195
    assert names == ["language", "quality", "simhash", "substrings", "packing"]


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 150


def test_a_run_leaves_the_results_of_others_alone(spark, tmp_path):
    """Two runs, whose results are read after both, and stages by hand between them."""
    for name, rows in (("a", corpus()), ("b", corpus()[:80])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    a = corpus_pipeline.run(spark, str(tmp_path / "a"))
    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path / "a")), name)
    b, again = corpus_pipeline.run(spark, str(tmp_path / "b")), corpus_pipeline.run(spark, str(tmp_path / "a"))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert 0 < len(key(b)) < len(key(a)) and key(a) == key(again)


def test_run_is_a_brute_force_chain(spark, tmp_path):
    """Verdicts of language and quality row by row, then near copies, repeated bytes and tokens by brute force over plain Python rows."""
    rng = random.Random(21)
    rows = corpus()
    passage = prose(rng, 25)
    for k in range(12):  # near copies and shared passages
        words = rows[k][1].split()
        words[5] = f"other{k}"
        rows.append((400 + k, " ".join(words), rows[k][2], "s", 0))
        rows.append((500 + k, f"{prose(rng, 110)} {passage} {prose(rng, 20)}", "en", "s", 0))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.2}
    one = [(i, t, found[i], s, n) for i, t, _, s, n in rows if i in found]
    good = {r["doc_id"] for r in quality.report(spark.createDataFrame(one, SCHEMA)).collect() if r["kept"]}
    two = [r for r in one if r[0] in good]
    single, _ = brute(two)
    three = sorted(((r[0], r[1]) for r in two if r[0] in single))
    four = [(i, np.frombuffer(b, np.uint8)[~m].tobytes().decode(errors="ignore")) for i, b, m in brute_cut(three, 50)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in four:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(i, p, a, e - a, zlib.crc32(ids[a:e].tobytes())) for p, (a, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert len(found) < len(rows) and len(two) < len(one) and len(three) < len(two) and any(len(t) < len(dict(three)[i]) for i, t in four)


def test_stages_take_columns_of_any_name_and_leave_little_behind(spark):
    docs = clashing(spark.createDataFrame(corpus(), SCHEMA)).withColumns({"page": docs_one(), "z": docs_one(), "whole": docs_one()})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = live()
        docs = materialise(stage(spark, docs, "unused"), name)
        assert docs.columns == columns and docs.count() > 100
        assert len(live() - before) <= 4


def docs_one():
    from pyspark.sql import functions as F

    return F.lit("x")
