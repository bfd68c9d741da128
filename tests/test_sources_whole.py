"""Paged sources that resume, corpora that are read until nothing is pending, relations of several sources, folds."""

import json

from pyspark.sql import functions as F

from lodestack.functions.identity import stripped
from lodestack.operators import lookups as K
from lodestack.operators import merge as M
from lodestack.sources import pages


def write(folder, number, text):
    (folder / f"page-{number}.json").write_text(text)


def rows(df):
    return sorted(tuple(r) for r in df.select("page", "position", "record", "bad").collect())


def test_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    src, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    src.mkdir()
    write(src, 0, json.dumps({"items": [{"id": "a", "n": 1}, {"n": 2}, 7]}))
    write(src, 1, json.dumps([{"id": "é"}]))
    write(src, 2, '{"items": [{"id"')
    pages.drain(spark, str(src), out, progress)
    first = rows(spark.read.parquet(out))
    assert [r[:2] + r[3:] for r in first] == [(0, 0, False), (0, 1, True), (0, 2, True), (1, 0, False), (2, -1, True)]
    write(src, 3, json.dumps({"items": []}))
    write(src, 10, json.dumps({"items": [{"id": "b"}] * 3}))
    # a new query with the same checkpoint takes the new pages only
    pages.drain(spark, str(src), out, progress)
    both = spark.read.parquet(out)
    assert both.filter("batch > 0").select("page").distinct().collect() == [(10,)]
    assert rows(both) == rows(pages.read(spark, str(src), pagesPerTask="1")) == rows(pages.read(spark, "file://" + str(src)))
    pages.drain(spark, str(src), out, progress)
    assert rows(spark.read.parquet(out)) == rows(both)
    assert sorted(map(tuple, pages.accounts(both).collect())) == [(0, 3, 1, 2), (1, 1, 1, 0), (2, 1, 0, 1), (10, 3, 3, 0)]


def test_no_pages(spark, tmp_path):
    assert pages.read(spark, str(tmp_path)).collect() == []


def test_reading_stops_once_nothing_is_pending(spark, tmp_path):
    texts = spark.range(400).select((F.col("id") % 40).cast("int").alias("file"), F.concat(F.lit("p"), (F.col("id") % 100).cast("string")).alias("key"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"), F.col("id").alias("at"))
    corpus = str(tmp_path / "corpus")
    texts.repartition("file").write.partitionBy("file").parquet(corpus)
    held = texts.collect()

    def brute(wanted):
        best = {}
        for r in sorted(held, key=lambda r: (r.file, r.at)):
            if len(r.text) >= 3:
                best.setdefault(r.key, (r.file, len(r.text)))
        return sorted((k, i, *best[k]) for k, i in wanted if k in best)

    for k, (keys, read) in enumerate([(["p0", "p1", "p1"], 6), (["p0", "p39", "none", None], 40), ([], 0)]):
        wanted = [(key, i) for i, key in enumerate(keys)]
        pending = spark.createDataFrame(wanted, "key string, id int")
        found, files = K.drain_files(spark, pending, corpus, "key", 3, str(tmp_path / f"run{k}"), first=2)
        assert sorted(tuple(r) for r in found.select("key", "id", "file", "n").collect()) == brute(wanted)
        assert files <= read and (files == 40) == ("none" in keys)


def test_relations_of_several_sources(spark):
    kind = "src string, dst string, type string, conf double"
    one = spark.createDataFrame([("hf-model--a", "hf-model--b", "USES", 0.5), ("HF-Model--A", "b", "USES", 0.9), ("a", "hf-model--a", "SELF", 1.0)], kind)
    two = spark.createDataFrame([("x", "a", None, None), ("report--b", "a", "USES", 1.0), ("a", "c", "", 0.0), (None, "a", "USES", 1.0)], kind)
    nodes = spark.createDataFrame([("tool/a",), ("zzz",)], "node string")
    got = sorted(map(tuple, K.around(nodes, [one, two]).collect()))
    assert got == [("tool/a", "b", "USES", 0.9, 0), ("tool/a", "c", "RELATED", 0.8, 1), ("tool/a", "x", "RELATED", 0.8, 1)]


def test_ids_as_they_are_compared(spark):
    ids = ["HF-Model--Meta/x", "arxiv:2401.1", "report--weekly", "--a----b--", "model--", "hf-models--a", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r[0] for r in df.select(stripped(F.col("id"))).collect()] == ["meta--x", "2401.1", "weekly", "a--b", None, "hf-models--a", None]


def test_fold_is_merging_one_after_another(spark):
    kind = "k int, at int, name string, n int, tags array<string>"
    all_rows = [(1, 2, None, 5, ["b"]), (1, 1, "one", 9, ["a", "b"]), (1, 3, None, None, None), (2, 1, None, None, None), (1, 0, "zero", 1, [])]
    df = spark.createDataFrame(all_rows, kind)
    got = {r.k: r for r in M.fold(df, "k", F.col("at"), greatest=["n"], union=["tags"]).collect()}
    want = df.filter("at = 0")
    for at in (1, 2, 3):
        want = M.merge_records(want, df.filter(f"at = {at} AND k = 1"), "k", greatest=["n"], union=["tags"])
    (one,) = want.collect()
    assert (got[1].folded, got[1].name, got[1].n, got[1].tags) == (4, one.name, one.n, sorted(one.tags)) and got[2].tags == []
