"""Greedy groups, set digests and versions of tables against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestack.operators import digests
from lodestack.operators.groups import greedy_groups, platform_groups


def greedy(ids, paired):
    """The pass that the rounds must equal."""
    leader = {}
    for i, a in enumerate(ids):
        if a in leader:
            continue
        leader[a] = a
        for b in ids[i + 1 :]:
            if b not in leader and paired(a, b):
                leader[b] = a
    return leader


@pytest.mark.parametrize("seed", range(3))
def test_rounds_are_a_greedy_pass(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range([30, 90, 400][seed])} | {(7, i) for i in range(40)}
    ids = sorted({x for p in pairs for x in p if p[0] != p[1]})
    want = greedy(ids, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    df = spark.createDataFrame([*pairs, *(p[::-1] for p in list(pairs)[:5])], "a long, b long")
    assert {r["id"]: r["leader"] for r in greedy_groups(df).collect()} == want
    assert greedy_groups(df.limit(0)).count() == 0


def alike(x, y):
    (_, n, a, p, h), (_, m, b, q, g) = x, y
    if h and g and h.lower() != g.lower() or p and q and abs(p - q) > 0.1:
        return False
    if n in m or m in n:
        return True
    s, t = n.rsplit("/", 1)[-1], m.rsplit("/", 1)[-1]
    return bool(a and b and a.lower() == b.lower() and (s in t or t in s))


def test_platform_groups_are_a_greedy_pass(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        author = rng.choice(["ann", "Ann", "bob", None])
        name = rng.choice(["mini", "mini-chat", "maxi", "ab", "qwen-7", "qwen-72"]) + rng.choice(["", "", "-v2", "-it"])
        rows.append((f"id{i:03d}", f"{(author or '').lower()}/{name}" if rng.random() < 0.7 else name, author, rng.choice([None, 7.0, 7.05, 70.0]), rng.choice(["", "llama", "Llama", None])))
    by = {r[0]: r for r in rows}
    leader = greedy([r[0] for r in rows], lambda a, b: alike(by[a], by[b]))
    size = Counter(leader.values())
    df = spark.createDataFrame(rows, "id string, norm string, author string, params_billions double, architecture string").repartition(4)
    assert {r["id"]: r["leader"] for r in platform_groups(df).collect()} == {i: x for i, x in leader.items() if size[x] > 1}


def test_digests_merge_and_lead_to_what_differs(spark):
    a = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    b = a.filter("v NOT IN ('v5', 'v1234')").unionByName(a.filter("v > 'v6'").limit(10)).unionByName(spark.createDataFrame([("new",), (None,)], "v string")).repartition(5)
    one, two, both = (digests.set_digest(x, "v").first() for x in (a, a.repartition(3).unionByName(a.limit(5)), b))
    assert one == two and one["digest"] != both["digest"] and (one["n"], both["n"]) == (20_000, 19_999)
    parts = digests.leaves(a.filter("v < 'v3'"), "v").unionByName(digests.leaves(a.filter("v >= 'v3'"), "v"))
    assert sorted(map(tuple, digests.combined(parts, 0).collect())) == sorted(map(tuple, digests.combined(digests.leaves(a, "v"), 0).collect()))
    found, compared = digests.drifted(digests.leaves(a, "v"), digests.leaves(b, "v"))
    assert len(found) == 3 and compared == [1, 16, compared[2], compared[3], compared[4]] and max(compared) <= 48
    assert {tuple(r) for r in digests.difference(a, b, "v").collect()} == {("left", "v5"), ("left", "v1234"), ("right", "new")}
    same, compared = digests.drifted(digests.leaves(a, "v"), digests.leaves(a, "v"))
    assert not same and compared == [1] and digests.difference(a, a, "v").isEmpty()
    none = a.limit(0)
    assert digests.set_digest(none, "v").first()["n"] == 0 and digests.difference(none, none, "v").isEmpty()


def test_versions_share_what_has_not_changed(spark, tmp_path):
    from lodestack.sources import versions

    path = str(tmp_path / "t")
    full = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("x"))
    assert versions.upsert(full, path, "key", 64) == 1 and versions.upsert(full.repartition(3), path, "key", 64) == 1
    one = versions.read(spark, path)
    batch = full.filter("x < 3").withColumn("x", F.col("x") + 10_000).unionByName(spark.createDataFrame([("new", 7)], "key string, x long"))
    assert versions.upsert(batch, path, "key", 64) == 2
    entries = {r["bucket"]: r["version"] for r in versions.manifest(spark, path).collect()}
    assert 1 <= sum(v == 2 for v in entries.values()) <= 4 and sum(v == 1 for v in entries.values()) >= 60
    got = {r["key"]: r["x"] for r in versions.read(spark, path).collect()}
    assert got == {f"k{i}": i + (10_000 if i < 3 else 0) for i in range(5000)} | {"new": 7}
    assert {r["key"]: r["x"] for r in one.collect()} == {f"k{i}": i for i in range(5000)}
    versions.upsert(batch.withColumn("x", F.lit(0).cast("long")), path, "key", 64)
    assert versions.prune(spark, path, 2) == [1] and versions.read(spark, path, 2).count() == 5001
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path, 1)


def test_versions_of_many_rows_share_what_has_not_changed(spark, tmp_path, monkeypatch):
    from lodestack.sources import versions

    path = str(tmp_path / "t")
    full = spark.range(60_000).select(F.format_string("k%06d", "id").alias("key"), "id")
    assert versions.upsert(full, path, "key") == 1
    assert versions.upsert(full.filter("id BETWEEN 20000 AND 22000").withColumn("id", -F.col("id")), path, "key") == 2
    entries = {r["bucket"]: r["version"] for r in versions.manifest(spark, path).collect()}
    assert 3 <= sum(v == 2 for v in entries.values()) <= 24 and len(entries) == 256
    # keys behind the last bound don't make a bucket without end
    monkeypatch.setattr(versions, "CUT_ROWS", 1000)
    assert versions.upsert(spark.range(60_000, 70_000).select(F.format_string("k%06d", "id").alias("key"), "id"), path, "key") == 3
    sizes = {r["bucket"]: r["n"] for r in versions.manifest(spark, path).collect()}
    assert sum(sizes.values()) == 70_000 and len(sizes) > 256 and max(sizes.values()) < 2000
    assert versions.upsert(spark.createDataFrame([("k069999", 5)], "key string, id long"), path, "key") == 4
    got = {r["key"]: r["id"] for r in versions.read(spark, path).collect()}
    assert got == {f"k{i:06d}": 5 if i == 69_999 else -i if 20_000 <= i <= 22_000 else i for i in range(70_000)}
    assert versions.read(spark, path, 1).count() == 60_000
