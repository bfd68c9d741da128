"""Operator 12 against exact integers and NumPy on the whole matrix, and on awkward tables."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import clashing

from lodestack.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def vectors(count=200, dim=40, seed=4):
    rng = np.random.default_rng(seed)
    made = (rng.normal(size=(count, dim)) * np.linspace(0.2, 3, dim)).astype(np.float32)
    made[::3] = made[0]  # a third are one vector
    return [v.tolist() for v in made]


def test_report_is_numpy_on_the_whole_matrix(spark):
    good = vectors()
    bad = [None, [], [NAN] + good[0][1:], [INF] + good[0][1:], [None] + good[0][1:], good[0][:5]]
    got = whitening.report(clashing(table(spark, bad + good))).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(np.array(good, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    assert got["vec_id"].drop_duplicates().tolist() == list(range(len(bad), len(bad) + n))
    assert (got.groupby("vec_id").size() == 32).all() and (got["n"] == n).all()
    far = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert got[got.component == 1]["deviation"].tolist() == far
    d = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    w = got["whitened"].to_numpy().reshape(n, 32)
    want = d @ axes[:, :32] / np.sqrt(values[:32])
    assert np.allclose(w, want * np.sign((w * want).sum(axis=0)), atol=1e-9)
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32), values[:32] / values.sum(), rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got["identity_error"].iloc[0] >= np.abs(w.T @ w / n - np.eye(32)).max() - 1e-12


def test_fewer_dimensions_and_components_without_variance(spark):
    flat = [[a, 2 * a, 5.0] for a in (0.0, 1.0, 2.0, 2.0)]
    got = whitening.report(table(spark, flat)).collect()
    assert Counter(r["component"] for r in got) == {1: 4} and {round(r["explained"], 9) for r in got} == {1.0}
    assert whitening.report(table(spark, [[1.0, 2.0]] * 3)).count() == 0


@pytest.mark.parametrize("rows", [[], [None, []], [[NAN]]])
def test_no_vector(spark, rows):
    got = whitening.report(table(spark, rows) if rows else spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_large_entries_stay_exact(spark):
    big = [[float(k << 40), 1.0] for k in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.report(table(spark, big)).collect()}
    x = [[int(a * 64) + 1_000_000, int(b * 64) + 1_000_000] for a, b in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = [sum((5 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert far[0] >= 1 << 63 and got == {i: v if v < 1 << 63 else None for i, v in enumerate(far)}
    assert whitening.report(table(spark, [[3e38, 1.0], [0.0, 1.0], [1.0, 1.0]])).agg(F.max("n")).first()[0] == 2


def test_repeated_and_null_ids_and_equal_results_however_dealt(spark):
    rows = [(None if i % 5 == 0 else i // 2, v, 1) for i, v in enumerate(vectors(60, 8))]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda d: sorted((str(r["vec_id"]), r["component"], r["deviation"], round(r["whitened"], 8)) for r in whitening.report(d).collect())
    assert key(df.repartition(7)) == key(df.coalesce(1)) and len(key(df)) == 60 * 8
