"""Rows of the mirror and of the served table, from records of several shapes."""

from lodestack.functions import metadata as M
from lodestack.operators import projections as P


def test_rows_of_records_with_few_columns(spark):
    df = spark.createDataFrame([("a--b", None, None), (None, ["x", "y"], "t")], "id string, tags array<string>, name string")
    mirror = P.table_row(df).collect()
    assert len(mirror[0]) == 23 and all(x is not None for r in mirror for x in r)
    assert (mirror[1]["tags"], mirror[0]["fni_s"], mirror[0]["stars"], mirror[0]["is_trending"]) == ("x, y", 50.0, 0, False)
    served = P.served_row(df).collect()
    assert len(served[0]) == 71
    assert served[0]["stars"] is None and served[0]["benchmarks"] is None and served[0]["citation"] is None
    assert (served[0]["hosted_on"], served[0]["datasets_used"], served[0]["license_type"], served[0]["can_run_local"]) == ("[]", "[]", "unknown", 0)


def test_rows_of_records_with_lists_and_structures(spark):
    kinds = "id string, umid string, tags array<string>, author array<string>, datasets_used array<string>, benchmarks array<struct<n:string,s:double>>, stars string, has_gguf boolean, params_billions double, is_trending int"
    df = spark.createDataFrame([("i", "", ["t" * 400, "u" * 400], ["A", "B"], ["X", "y"], [("m", 1.5)], "0", True, 0.0, 2), ("j", None, None, None, None, None, "", None, 70.0, None)], kinds)
    one, two = P.served_row(df).collect()
    assert (one["umid"], one["author"], one["datasets_used"], one["benchmarks"]) == ("i", "A, B", '["x","y"]', '[{"n":"m","s":1.5}]')
    assert len(one["tags"]) == 500 and (one["stars"], one["params_billions"], one["can_run_local"], one["is_trending"]) == (0.0, None, 1, 1)
    assert (two["umid"], two["stars"], two["benchmarks"], two["can_run_local"]) == ("j", None, None, 0)


def test_citations_name_what_is_known(spark):
    rows = [("a/b", "A title", "Ann", 2020.0, "https://x.org/1"), ("a/b", "a/b", "Ann", 2020.0, None), ("a", "Unknown", None, None, None), ("a", "0123456789abcdef0", None, None, None), ("a", " ", None, None, None), ("a", None, None, None, None), ("a", "T", " ", 1990.0, "https://own.org/x"), (None, "T u", None, 2000.5, "ftp://x")]
    df = spark.createDataFrame(rows, "id string, title string, author string, year double, url string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(M.citation(F.col("id"), F.col("title"), [F.col("id")], F.col("author"), F.col("year"), F.col("url"), "own.org", "N")).collect()]
    assert got[0] == "@misc{a_b,title={A title},author={Ann},year={2020},url={https://x.org/1},note={N}}"
    assert got[1:6] == [None] * 5
    assert got[6:] == ["@misc{a,title={T},note={N}}", "@misc{T_u,title={T u},note={N}}"]
