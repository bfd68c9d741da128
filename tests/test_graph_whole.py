"""Terms by one automaton and whole neighbourhoods, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.functions import patterns
from lodestack.operators import graph as G


def plain_counts(terms, text):
    out = []
    for k, t in enumerate(terms):
        if t and t in text:
            out.append((k, text.count(t), sum(t in w for w in text.split())))
    return out


def test_automaton_counts_as_single_searches_do():
    rng = random.Random(4)
    terms = ["aa", "aba", "a b", "ab", "b", "é", "ba ", "abab", "aaaa", ""]
    found = patterns.automaton(terms)
    for _ in range(2000):
        text = "".join(rng.choice("aab b é\n") for _ in range(rng.randint(0, 30)))
        assert patterns.count(found, text) == plain_counts(terms, text), text


def test_occurrences_as_a_column(spark):
    texts = ["red fox, red fox", None, "", "no terms", "foxfox red"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    terms = ["fox", "red fox", *(f"filler{k}" for k in range(5000))]
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in df.select("i", patterns.occurrences(spark, terms)(F.col("t")).alias("x")).collect()}
    assert got == {0: [(0, 2, 2), (1, 2, 0)], 1: [], 2: [], 3: [], 4: [(0, 2, 1)]}
    assert [r["x"] for r in df.select(patterns.occurrences(spark, [])(F.col("t")).alias("x")).collect()] == [[]] * 5
    with pytest.raises(ValueError, match="more than"):
        patterns.occurrences(spark, ["x"] * (patterns.MOST_TERMS + 1))


@pytest.mark.parametrize("hub", [10, 100_000])
def test_neighbourhoods_are_whole(spark, hub):
    """A hub of most edges, some nodes of a chunk exactly, and ties in confidence."""
    rng = random.Random(1)
    edges = [("hub", f"d{i:05d}", "USES", rng.randint(0, 5)) for i in range(997)] + [(f"s{i % 30}", f"d{i}", "CITES", i % 3) for i in range(300)]
    df = spark.createDataFrame(edges, "src string, dst string, verb string, conf int").repartition(5)
    want = defaultdict(list)
    for s, d, v, c in sorted(edges, key=lambda e: (e[0], -e[3], e[1], e[2])):
        want[s].append((d, v, c))
    got, sizes = defaultdict(list), {}
    for r in sorted(G.listed(df, "src", G._sure(), ["dst", "verb", "conf"], chunk=10, hub=hub).collect(), key=lambda r: (r["src"], r["chunk"])):
        assert r["chunk"] == len(got[r["src"]]) // 10 and 0 < len(r["items"]) <= 10
        got[r["src"]] += [tuple(x) for x in r["items"]]
        sizes[r["src"]] = r["n"]
    assert got == want and sizes == {s: len(x) for s, x in want.items()}
    assert G.adjacency(df.limit(0)).count() == 0


def test_term_links_take_the_first_terms_of_the_registry(spark):
    e = spark.createDataFrame([("a", "one two"), ("b", "one"), ("c", "three"), ("d", "Two-three")], "id string, t string")
    terms = spark.createDataFrame([(1, "T", ["TWO", "one"]), (0, "O", ["one"]), (2, "H", ["three", "x y"])], "at int, term string, aliases array<string>")
    got = Counter(tuple(r) for r in G.term_links(e, "id", F.col("t"), terms, least=0.0, most=1).collect())
    assert got == Counter([("a", "O", "one", 0.347), ("b", "O", "one", 0.693), ("c", "H", "three", 0.693), ("d", "T", "TWO", 0.288)])


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def clusters_of(spark, pairs, **how):
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    return {r["id"]: r["cluster"] for r in G.identity_clusters(df, **how).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(rng.choice([80, 220, 600]))]
    assert clusters_of(spark, pairs) == plain_components(pairs)


def test_clusters_of_a_long_chain_and_of_a_hub(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 10_000)
    pairs = list(zip(ids, ids[1:], strict=False))
    got = clusters_of(spark, pairs)
    assert len(got) == 10_000 and set(got.values()) == {min(ids)}
    hub = [(500_000, i) for i in range(100_000)] + [(10**7, 10**7 + 1)]
    got = clusters_of(spark, hub)
    assert len(got) == 100_003 and Counter(got.values()) == {0: 100_001, 10**7: 2}


def test_gates_of_clusters(spark):
    chain = [(i, i + 1) for i in range(200)]
    with pytest.raises(RuntimeError, match="MAX_PASSES_EXCEEDED"):
        clusters_of(spark, chain, max_passes=3)
    with pytest.raises(RuntimeError, match="PARTITION_SKEW"):
        clusters_of(spark, chain, parts=1)
    assert len(clusters_of(spark, chain[:10], parts=1)) == 11
    with pytest.raises(RuntimeError, match="NON_SINGLETON_FLOOR"):
        clusters_of(spark, [(1, 1)], expect=True)
    assert clusters_of(spark, [(1, 1)]) == {}


def test_containment_is_what_all_pairs_give(spark):
    from lodestack.operators.containment import contained

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words, texts = [word(rng.randint(1, 6)) for _ in range(300)], [word(rng.randint(0, 9)) for _ in range(200)] + [None]
    w, t = spark.createDataFrame([(x,) for x in words], "w string"), spark.createDataFrame([(x,) for x in texts], "t string")
    found = contained(w, "w", t, "t")
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in words for b in texts if b is not None and a in b}
    assert found.count() == found.distinct().count() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_term_links_take_registries_beyond_one_automaton(spark):
    from lodestack.functions.patterns import MOST_TERMS

    many = spark.range(MOST_TERMS + 1).select(F.lit(1).alias("at"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), F.array(F.concat(F.lit("zq"), F.col("id").cast("string"), F.lit("_"))).alias("aliases"))
    few = spark.createDataFrame([(0, "first", ["No Such", "red  ", "RED"]), (2, "pair", ["red bolt", "bolt"])], "at int, term string, aliases array<string>")
    e = spark.createDataFrame([("a", "Red bolt zq7_ x"), ("b", "Red bolt zq7_ x"), ("c", "plain"), ("d", None), ("e", "ared red")], "id string, t string")
    got = sorted((r["id"], r["term"], r["alias"], r["score"]) for r in G.term_links(e, "id", F.col("t"), few.unionByName(many), least=0.0).collect())
    share = [round(x, 3) for x in (0.25 * math.log(5 / 3), 0.25 * math.log(5 / 2), 1.0 * math.log(5 / 3))]
    both = [("first", "RED", share[0]), ("pair", "red bolt", 0.0), ("t7", "zq7_", share[1])]
    assert got == sorted([(i, *x) for i in "ab" for x in both] + [("e", "first", "RED", share[2])])
