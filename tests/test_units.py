"""Golden values and edge cases of the operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.api import Catalogue
from lodestack.functions import identity, scoring
from lodestack.functions import metadata as M
from lodestack.functions import text as X
from lodestack.functions import vectors as V
from lodestack.operators import clusters, filters, graph, matching, merge, rank
from lodestack.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_digests(spark):
    assert one(spark, X.short_id(F.lit("hf-model--meta-llama--llama-3"))) == "52eaca4b97d1964e"
    assert one(spark, X.edge_id(F.lit("a"), F.lit("CITES"), F.lit("b"))) == "ffd8a01cc0e4f9af"


@pytest.mark.parametrize(
    ("scores", "want"),
    [([100, 0, 0, 0], [100, 50, 50, 50]), ([], []), ([7], [100]), ([90, 50, 10], [100, 67, 33])],
)
def test_midrank(spark, scores, want):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, s double")
    got = [r["percentile"] for r in rank.midrank_percentile(df, "s").orderBy("i").collect()]
    assert got == [max(1, int(np.floor((1 - (sum(t > s for t in scores) + (scores.count(s) - 1) / 2) / len(scores)) * 100 + 0.5))) for s in scores] and len(got) == len(want)


def test_undated_entities_get_a_year(spark):
    assert round(one(spark, scoring.recency(F.lit("model"), F.lit(None).cast("int"))), 3) == round(100 * np.exp(-0.002 * 365), 3)
    assert one(spark, scoring.staleness(F.lit("paper"), F.lit(None).cast("int"))) == 1.0


@pytest.mark.parametrize(
    ("id", "source", "type", "want"),
    [
        ("Owner/Name", "huggingface", "model", "hf-model--owner--name"),
        ("hf-model--owner--name", None, None, "hf-model--owner--name"),
        ("arxiv-paper--2301.12345v2", None, None, "arxiv-paper--2301.12345"),
        ("owner/some-tool", "github", None, "gh-tool--owner--some-tool"),
        ("dataset--squad.md", "hf", None, "hf-dataset--squad"),
        ("", "hf", "model", None),
        (None, None, None, None),
    ],
)
def test_canonical_ids(spark, id, source, type, want):
    assert one(spark, identity.canonical(*(F.lit(x).cast("string") for x in (id, source, type)))) == want


def test_stems(spark):
    words = ["relational", "models", "running", "ponies", "is", "happiness", "training", "agreed", "feed", "cement", "dies", "controller", "nation", "sky", "will"]
    want = ["relate", "model", "runn", "poni", "is", "happi", "train", "agree", "feed", "ce", "die", "control", "nate", "ski", "wil"]
    assert one(spark, X.stems(F.array(*map(F.lit, words)))) == want


def test_only_the_first_block_is_front_matter(spark):
    text = "intro\n---\nbody one\n---\nmid\n---\nbody two\n---\nend"
    assert one(spark, X.clean_abstract(F.lit(text))) == "intro mid --- body two --- end"


def test_titles_of_papers_are_headings(spark):
    html = '<div class="ltx_title x">A <b>bold</b> title</div><h3> Sub <i>part</i></h3><div class="ltx_p">One</div><p>Two</p>'
    assert one(spark, X.main_content(F.lit(html))).split() == ["##", "A", "bold", "title", "###", "Sub", "part", "One", "Two"]


def test_epochs_are_ordered_by_number(spark, tmp_path):
    path = str(tmp_path / "many")
    for k in range(8, 12):
        sinks.write_epoch(spark.range(k), path, f"e{k}", keep=2)
    assert sinks.read_latest(spark, path).count() == 11
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["epoch=e10", "epoch=e11"]


def test_match_score_of_equals_is_one(spark):
    row = ("abc", "Me", 7.0, "MIT", "x", None)
    df = spark.createDataFrame([row], "slug string, author string, params_billions double, license string, pipeline_tag string, architecture string")
    other = spark.createDataFrame([("abc", " me ", 7.0, "mit", "X", None)], df.schema)
    assert df.alias("x").crossJoin(other.alias("y")).select(matching.match_score("x", "y").alias("s")).first()["s"] == pytest.approx(1.0)


def test_licence_order(spark):
    want = {"limited use": "permissive", "MIT": "permissive", "gpl-3.0": "copyleft", "cc-by-nc-4.0": "non-commercial", "": "unknown", "strange": "unknown"}
    for text, label in want.items():
        assert one(spark, M.license_class(F.lit(text))) == label
    assert one(spark, M.license_class(F.lit(None).cast("string"))) == "unknown"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == 1.0 and one(spark, V.cosine(a, b)) == 0.0
    assert one(spark, V.quantise(F.array(F.lit(2.0), F.lit(-2.0), F.lit(0.5)))) == [127, -128, 64]


def test_html(spark):
    html = "<html><nav>menu</nav><script>x</script><h2>Head</h2><p>One &amp; two</p><p class='a'>Three</p></html>"
    assert one(spark, X.main_content(F.lit(html))).split() == ["##", "Head", "One", "&", "two", "Three"]
    assert one(spark, X.content_class(F.lit("a" * 300))) == "PARTIAL" and one(spark, X.content_class(F.lit("a"))) == "SKIP"


def test_front_matter(spark):
    assert one(spark, X.front_matter(F.lit("---\ntitle: A: b\ntags: x\n---\nbody"))) == {"title": "A: b", "tags": "x"}


def test_query_language(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "small ring", 7.0), (2, "Bob", "ring", 3.0), (3, None, "ring", None)], "i int, author string, name string, p double")
    keep = lambda q: [r["i"] for r in df.filter(filters.parse(q, ["name"], {"author": "author"}, {"params": "p"})).collect()]
    assert keep('author:"ann lee" ring') == [1] and keep("params:>=3 ring") == [1, 2] and keep("nothing:here") == [] and keep("") == [1, 2, 3]


def test_merge_keeps_both_sides(spark):
    old = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "b", None, None)], "k int, name string, n int, tags array<string>")
    new = spark.createDataFrame([(2, None, 3, ["y"]), (3, "c", 1, ["z"])], "k int, name string, n int, tags array<string>")
    got = {r["k"]: (r["name"], r["n"], r["tags"]) for r in merge.merge_records(old, new, "k", ["n"], ["tags"]).collect()}
    assert got == {1: ("a", 5, ["x"]), 2: ("b", 3, ["y"]), 3: ("c", 1, ["z"])}


def test_clusters(spark):
    pairs = spark.createDataFrame([("z", "m"), ("m", "a"), ("a", "q"), ("t", "s"), ("u", "u")], "a string, b string")
    got = {r["id"]: r["cluster"] for r in graph.identity_clusters(pairs).collect()}
    assert got == {"z": "a", "m": "a", "a": "a", "q": "a", "t": "s", "s": "s"}
    assert graph.identity_clusters(pairs.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.identity_clusters(spark.range(200).selectExpr("id a", "id + 1 b"), max_passes=1)


def test_alternatives_leave_out_self_and_empty(spark):
    df = spark.createDataFrame([("a", "c", ["x", "y"]), ("b", "c", ["x", "y"]), ("d", "c", ["x"]), ("e", "c", []), ("f", "o", ["x", "y"])], "id string, cat string, tags array<string>")
    got = {(r["id"], r["other"]): r["sim"] for r in graph.tag_alternatives(df, "id", "cat", "tags").collect()}
    assert got == {("a", "b"): 100, ("b", "a"): 100, ("a", "d"): 50, ("b", "d"): 50, ("d", "a"): 50, ("d", "b"): 50}


def test_kmeans_moves_to_means(spark):
    rows = [(i, [float(i % 2) * 10 + 0.1 * (i % 5), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cents = sorted(r["centroid"][0] for r in clusters.kmeans(df, "id", "v", 2, 8, seed=1).collect())
    assert len(cents) == 2 and all(np.isfinite(cents))


def test_shards_by_preference(spark):
    df = spark.createDataFrame([("x/part-1.json",), ("x/part-1.parquet",), ("x/part-2.json.gz",), ("x/other.json",)], "path string")
    assert {tuple(r) for r in readers.preferred_shards(df).collect()} == {(1, "x/part-1.parquet"), (2, "x/part-2.json.gz")}


def test_json_documents(spark, tmp_path):
    for name, body in {"a": '[{"id": "1"}, {"id": "2"}]', "b": '{"entities": [{"id": "3"}]}', "c": '{"id": "4"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    assert sorted(r["id"] for r in readers.read_json_documents(spark, str(tmp_path), "id string").collect()) == ["1", "2", "3", "4"]


def test_parse_report(spark):
    df = spark.createDataFrame([("f", '{"a": 1}'), ("f", "junk"), ("g", '{"a": 2}')], "file string, line string")
    got = {r["file"]: (r["declared"], r["parsed"], r["dropped"]) for r in readers.parse_report(df, "line", "a int", "file").collect()}
    assert got == {"f": (2, 1, 1), "g": (1, 1, 0)}


def test_atom(spark):
    xml = '<feed><entry><id>http://arxiv.org/abs/2301.00001v2</id><title>On\n A &amp; B</title><summary>s</summary><published>2023-01-02T00:00:00Z</published><author><name>Ann</name></author><category term="cs.AI"/></entry></feed>'
    r = readers.atom_entries(spark.createDataFrame([(xml,)], "x string"), "x").first()
    assert (r["id"], r["title"], r["authors"], r["categories"], r["published"]) == ("2301.00001", "On A & B", ["Ann"], ["cs.AI"], datetime.date(2023, 1, 2))


def test_epochs_are_kept_in_number(spark, tmp_path):
    path = str(tmp_path / "mirror")
    for k in range(4):
        sinks.write_epoch(spark.range(k + 1), path, f"e{k}", keep=2)
    assert sinks.read_latest(spark, path).count() == 4
    assert sorted(p.name for p in (tmp_path / "mirror").iterdir()) == ["epoch=e2", "epoch=e3"]


def test_compare_keeps_order_and_marks(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "id string, slug string")
    got = [(r["req"], r["status"], r["id"]) for r in Catalogue(df).compare(["t", "none", "s", "a"]).orderBy("pos").collect()]
    assert got == [("t", "OK", "c"), ("none", "NOT_FOUND", None), ("s", "AMBIGUOUS", "a"), ("a", "OK", "a")]
    with pytest.raises(ValueError):
        Catalogue(df).compare(["a"])


def test_sums_by_ranges_are_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.integers(0, 60, 300))], "i int, s double").repartition(5)
    want = sorted(map(tuple, rank.midrank_percentile(df, "s").collect()))
    monkeypatch.setattr(rank, "ONE_TASK", 7)
    assert sorted(map(tuple, rank.midrank_percentile(df, "s").collect())) == want
    assert sinks.numbered(df, [F.desc("s"), F.asc("i")]).filter("row = 0").first()["s"] == 59.0


def test_unchanged_tables_are_not_written(spark, tmp_path):
    path, df = str(tmp_path / "v"), spark.range(10)
    assert [sinks.write_if_changed(x, path) for x in (df, df.orderBy(F.desc("id")), df.limit(9), df)] == [True, False, True, True]
