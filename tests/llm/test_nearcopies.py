"""The near-duplicate stage of the pipeline against brute force over five-word shingles."""

import random

import numpy as np
import pytest
from test_operators import SCHEMA, awkward, clashing, prose

import corpus_pipeline
from lodestack.llm import nearcopies


def brute(rows):
    """Smallest doc_id of each component of pairs with a Jaccard similarity of 0.8 or more, and the number of such pairs."""
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up, pairs = {k: k for k in sets}, 0

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {root(k) for k in sets}, pairs


@pytest.mark.parametrize("piece", [nearcopies.PIECE, 4])
def test_copies_of_similarity_080_are_linked(spark, monkeypatch, piece):
    monkeypatch.setattr(nearcopies, "PIECE", piece)
    rng, rows = random.Random(4), []
    for k in range(30):
        words = prose(rng, 300).split()
        rows.append((k, " ".join(words), "en", "s", 0))
        for c, changes in enumerate((1, 2, 3, 4, 5, 6, 9)):  # similarity about 0.97 to 0.7
            near = list(words)
            for at in rng.sample(range(len(near)), changes):
                near[at] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 10 * k + c, " ".join(near), "en", "s", 0))
    want, pairs = brute(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").select("doc_id").collect()}
    assert pairs > 300 and kept == want


def test_awkward_rows(spark):
    """Nulls, empties, copies, repeated ids and clashing names: a row for each component, that of the smallest id."""
    rows = [r for r in awkward() if r[0] is not None and r[:1] not in ((5,), (7,))] + [(5, awkward()[5][1], "en", "s", 1)] * 3
    want, _ = brute(rows)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = nearcopies.keep_one(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert nearcopies.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []
    nulls = spark.createDataFrame([(None, prose(random.Random(1), 50), "en", "s", 1)] * 4, SCHEMA)
    assert nearcopies.keep_one(nulls).count() == 1


@pytest.mark.parametrize("split", [nearcopies.SPLIT_ROWS, 20])
def test_candidates_come_from_fingerprints(spark, monkeypatch, split):
    """Pairs of similarity 0.8, short ones and a large group of near copies meet by keys of their fingerprints; unrelated sets do not."""
    monkeypatch.setattr(nearcopies, "SPLIT_ROWS", split)
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    sets = []
    for n in [4] * 50 + [36] * 100 + [270] * 100:  # n of n + n / 8 + n / 8, a similarity of 0.8; 4 of 5
        both, more = draw(n), n // 8
        sets += [np.concatenate([both, draw(more)]), np.concatenate([both, draw(more or 1)])]
    centre = draw(300)
    sets += [np.concatenate([centre, draw(5)]) for _ in range(300)] + [draw(200) for _ in range(300)]
    rows = [(k, len(x) < nearcopies.FEW, nearcopies.long_fingerprint(np.sort(x)).view(np.int64).tolist()) for k, x in enumerate(sets)]
    found = {r["node"]: r["root"] for r in nearcopies.candidates(spark.createDataFrame(rows, "fp long, few boolean, signs array<long>"), 0.8).collect()}
    assert found == {k: k - k % 2 for k in range(500)} | dict.fromkeys(range(500, 800), 500)


@pytest.mark.parametrize("size", [2, 64, nearcopies.SMALL, nearcopies.SMALL + 1, 900])
def test_links_of_a_key_are_those_of_brute_force(size):
    """Two keys, groups compared by shifts and query by query: the same components as all pairs within both radii."""
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 64, (5, nearcopies.COMPARED), np.uint64)
    flips = np.packbits(rng.random((2 * size, 64 * nearcopies.COMPARED)) < 0.12, axis=1, bitorder="little").view(np.uint64)
    signs = centres[rng.integers(0, 5, 2 * size)] ^ flips
    key = rng.permutation(np.repeat([7, 9], size))
    a, b = nearcopies.key_links(key, np.arange(2 * size), signs, 16, 45)
    up = list(range(2 * size))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(2 * size):
        apart = np.bitwise_count(signs[i + 1 :] ^ signs[i])
        for j in i + 1 + np.flatnonzero((key[i + 1 :] == key[i]) & (apart[:, 0] <= 16) & (apart.sum(axis=1, dtype=int) <= 45)):
            x, y = root(i), root(int(j))
            up[max(x, y)] = min(x, y)
    got = list(range(2 * size))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        got[x] = y
    assert got == [root(x) for x in range(2 * size)]


@pytest.mark.parametrize("size", [40, nearcopies.SMALL + 1, 900])
def test_links_of_labels_join_what_is_not_linked_yet(size):
    """With labels from earlier links, the edges of labels and those links connect what all pairs do; within a label none is returned."""
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 64, (4, nearcopies.COMPARED), np.uint64)
    group = rng.integers(0, 4, size)
    signs = centres[group] ^ np.packbits(rng.random((size, 64 * nearcopies.COMPARED)) < 0.05, axis=1, bitorder="little").view(np.uint64)
    one = np.zeros(size, np.int64)
    a, b = nearcopies.key_links(one, np.where(group < 2, 7, 1000 + np.arange(size)), signs, 24, 60)
    root = np.array([7 if g < 2 else 1000 + np.flatnonzero(group == g)[0] for g in group])
    want = {1000 + k: int(root[k]) for k in np.flatnonzero(group >= 2).tolist()}
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: y for x, y in want.items() if x != y}
    assert not len(nearcopies.key_links(one, group, signs, 24, 60)[0])


def test_a_large_group_is_named_by_few_keys(spark, monkeypatch):
    """Tasks of all keys return a few links for each of many near copies, not some for each of the keys, and the group stays whole."""
    frame = type(spark.range(0))
    made, real = [], frame.mapInArrow

    def counted(df, func, schema, *more, **options):
        out = real(df, func, schema, *more, **options)
        if schema == "a long, b long":
            made.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 64, 300, np.uint64)
    rows = []
    for k in range(400):
        one = centre.copy()
        one[rng.choice(300, 6, replace=False)] = rng.integers(0, 1 << 64, 6, np.uint64)
        rows.append((k, False, nearcopies.long_fingerprint(np.sort(one)).view(np.int64).tolist()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        found = {r["node"]: r["root"] for r in nearcopies.candidates(spark.createDataFrame(rows, "fp long, few boolean, signs array<long>"), 0.8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == dict.fromkeys(range(400), 0)
    assert 0 < sum(made) <= 9 * 400
