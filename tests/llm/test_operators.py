"""The training-data operators against brute force, round trips and held-out labels, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import bpe, components, editcounts, gif, language, packing, quality, sharding, simhash, substrings, textkit, toxicity

WORDS = "the and of to in is that it for was on with as this are ring stone river light cloud paper house green small open".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def awkward():
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, repeated ids."""
    rng = random.Random(5)
    passage = prose(rng, 30)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    texts = [None, "", "   \n\t", "x", "Zeile\nZeile\nZeile", base[0], base[0], base[0], base[1] + " extra", base[1], passage + base[2], base[3] + passage, "é" * 30 + passage, "日本語 " * 40, base[4] * 60, "a" * 5000, *base[5:]]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, base[0], "en", None, None), (None, None, None, None, None), (5, base[0], "en", "s", 1), (7, base[7], "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns whose names the operators might use inside."""
    return df.withColumns({c: F.lit(1) for c in ("fp", "rank", "n", "k1", "k2", "id", "key", "spans", "row", "kept", "words", "ref", "grp", "bin", "score", "root", "u", "v", "z")})


def labels_for(df):
    return df.filter("doc_id is not null").select("doc_id").distinct().select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


RUNS = {
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels_for(d))),
    "bpe": bpe.digests,
    "quality": quality.report,
    "gif": gif.round_trip,
    "packing": packing.pack,
    "edits": lambda d: editcounts.count_edited(d.select("doc_id", "text", editcounts.usual_edits().alias("edits"))),
    "sharding": sharding.shard,
    "language": lambda d: language.identify(d, language.fit(d)),
    "simhash": simhash.near_duplicates,
    "substrings": substrings.dedup_report,
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_row_and_none_for_none(docs, empty, name):
    got = RUNS[name](clashing(docs)).collect()
    if name == "packing":
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    else:
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    plain = RUNS[name](docs).collect()
    if name not in ("packing", "sharding"):
        assert Counter(map(str, got)) == Counter(map(str, plain))
    assert RUNS[name](empty).count() == 0


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def test_bpe_is_tiktoken(docs):
    enc, texts = encoding(), Counter(r["text"] for r in docs.collect())
    want = Counter()
    for t, n in texts.items():
        ids = enc.encode_ordinary(t or "")
        want[(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += n
    assert Counter((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs).collect()) == want


def test_bpe_on_random_strings():
    rng, enc, encoder = random.Random(3), encoding(), bpe.Encoder(bpe.load_ranks(), memo=50)
    signs = list("aabbccthe''sstréß日١²  \u0085\x1c.,!<|>") + [" "] * 12 + ["\n"] * 4
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == enc.encode_ordinary(t)
    long = "ab" * 4000
    assert np.frombuffer(encoder.encode(long), "<u4").tolist() == enc.encode_ordinary(long)


def test_bpe_columns_round_trip(docs):
    ids = bpe.encode_column(docs.filter("doc_id > 7"))
    got = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode_column(ids).collect()}
    assert got == {r["doc_id"]: r["text"] or "" for r in docs.filter("doc_id > 7").collect()}


def base_figures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(places), len(w) < 50 or 100 * len(places) > 50 * len(w)


def test_quality_base(docs):
    want = Counter(base_figures(r["text"]) for r in docs.collect())
    got = quality.report(docs).collect()
    assert Counter(tuple(r)[1:7] for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_distance(spark):
    a, b = F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(3))
    r = spark.range(1).select(quality.distance(a, b).alias("far"), quality.distance(a, a).alias("same"), quality.distance(a, F.array(F.lit(0), F.lit(0))).alias("none")).first()
    assert r["far"] == 1.0 and r["same"] == 0.0 and r["none"] is None


def test_quality_rejects_signs_and_keeps_prose(spark):
    rng = random.Random(1)
    texts = [prose(rng, 150) for _ in range(40)] + [" ".join(w + "***" for w in prose(rng, 150).split()) for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} <= set(range(40))
    assert quality.keep_good(df).count() >= 38


def test_lzw_round_trip_and_errors():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 4000, 60_000):
        for top in (1, 3, 256):
            d = bytes(rng.integers(0, top, n, dtype=np.uint8))
            assert gif.lzw_decode(gif.lzw_encode(d), 8) == d
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff\xff\xff\xff", 8)


def test_gif_rules():
    """Two frames by hand: a red 2x1 base that stays, then one green pixel with a transparent neighbour; disposal restores."""

    def frame(codes, flags, transparent, disposal, delay):
        stream = gif.lzw_encode(bytes(codes), 2)
        return bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, 0, transparent or 0, 0, 0x2C, 0, 0, 0, 0, 2, 0, 1, 0, flags, 2, len(stream)]) + stream + b"\0"

    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = head + frame([1, 1], 0, None, 1, 5) + frame([0, 2], 0, 0, 3, 7) + frame([3, 0], 0, 0, 2, 1) + frame([0, 0], 0, 0, 0, 0) + b";"
    frames = gif.read(data)
    assert [f.rgb[0].tolist() for f in frames] == [[[255, 0, 0], [255, 0, 0]], [[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 0, 0]], [[0, 0, 0], [0, 0, 0]]]
    assert [f.delay_ms for f in frames] == [50, 70, 10, 0]
    assert gif.histogram(frames[1]).tolist()[1][15] == 1


def test_gif_payload(docs):
    for r in gif.round_trip(docs).collect():
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= 192
    want = Counter((len((t or "").encode()), hashlib.sha256(gif.payload(t)[0]).hexdigest(), zlib.crc32(gif.payload(t)[0][-16:])) for t in (r["text"] for r in docs.collect()))
    assert Counter((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in gif.round_trip(docs).collect()) == want
    media = gif.media_column(docs)
    assert gif.frames_column(media).groupBy("doc_id").count().count() == media.select("doc_id").distinct().count()


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, group_pieces=10).collect()
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append(r)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))] and sum(r["length"] for r in rows) <= 1024
    want = Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len(by_seq) <= 1.2 * -(-sum(r["length"] for r in got) // 1024) + 1


def test_packing_is_tight(spark):
    rng = random.Random(11)
    texts = [prose(rng, max(1, int(rng.gammavariate(1.2, 250)))) for _ in range(3000)]
    got = packing.pack(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len({r["sequence_id"] for r in got}) <= 1.01 * -(-sum(r["length"] for r in got) // 1024)


def test_special_strings_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b  c", "<|endoftext", "plain words", "", "two  spaces", "<|endoftext|><|endoftext|>\n"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def test_crossover_keeps_every_item():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1023) for _ in range(300)]
    a = packing.best_fit(sizes, list(range(300)), [], 1024)
    b = packing.best_fit(sizes, sorted(range(300), key=lambda i: -sizes[i]), [], 1024)
    for child in (packing.crossover(sizes, a, b, 1024, rng), packing.mutate(sizes, a, 1024, rng), packing.evolve(sizes, a, 1, 1024)):
        assert sorted(i for bin in child for i in bin) == list(range(300)) and all(sum(sizes[i] for i in bin) <= 1024 for bin in child)
    assert len(packing.evolve(sizes, None, 1, 1024)) <= len(b)


def test_edits_count_as_a_fresh_count():
    rng, enc, encoder = random.Random(4), encoding(), bpe.Encoder(bpe.load_ranks())
    signs = list("ab 's t're'll  \n\n\t12.,!é日ab ")
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 40, 400, 3000])))
        tree = editcounts.CountTree(text, encoder)
        for _ in range(5):
            start, length = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 2, 10, 300])
            new = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 8, 200])))
            at = min(max(start, 0), len(text))
            text = text[:at] + new + text[min(at + length, len(text)) :]
            assert tree.edit(start, length, new) == len(enc.encode_ordinary(text)) and tree.text == text
    tree = editcounts.CountTree("word " * 20_000, encoder)
    tree.edit(50_000, 3, "new")
    assert tree.encoded < 20 and tree.nodes < 30


def test_edited_trees_are_kept(spark, docs):
    kept = editcounts.trees(docs.filter("doc_id between 8 and 20"))
    edits = spark.createDataFrame([(9, 0, 0, 0, "Start "), (9, 1, 5, 2, None), (10, 0, 3, 4, "x"), (999, 0, 0, 0, "y")], "doc_id long, number int, start int, length int, replacement string")
    enc = encoding()
    for r in editcounts.apply_edits(kept, edits).collect():
        assert sum(r["counts"]) == len(enc.encode_ordinary(r["text"])) and sum(r["lens"]) == len(r["text"])


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_feistel_is_a_bijection(n):
    assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))


def test_shards(docs):
    got = sharding.shard(docs).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(24)) <= 1
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(docs.repartition(7)).collect()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    sets = {"aa": WORDS, "bb": "der die und das ist nicht ein eine zu den von mit auf sich auch wird".split(), "cc": "el la de que y en los se del las un por con una su para".split()}
    rows = [(i, " ".join(rng.choice(sets[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(rng.choice(list(sets)) for _ in range(600))]
    df = spark.createDataFrame([*rows, (1000, None, None), (1001, "123 !!", "aa"), (1002, "。。。！" * 20, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df)).collect()}
    held = [(got[i]["lang_pred"], k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) > 0.97 * len(held) > 0
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert {r["doc_id"] for r in language.keep_known(df, language.fit(df)).collect()} == set(range(600))


def test_many_languages_need_more_than_a_word_of_bits(spark):
    rng = random.Random(8)
    sets = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(15)] for _ in range(70)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(sets[i % 70]) for _ in range(40)), f"l{i % 70:02}") for i in range(1400)], "doc_id long, text string, lang string")
    got = language.identify(df, language.fit(df)).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            words[rng.randrange(60)] = rng.choice(["idiot", "scum", "moron"])
            words[rng.randrange(60)] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    held = toxicity.score(df, model).join(df.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in held) > 0.97 * len(held)
    assert np.count_nonzero(model.w) < 2000


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(prints):
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in prints:
        for y in prints:
            if bin(x ^ y).count("1") <= 4:
                up[max(root(x), root(y))] = min(root(x), root(y))
    return {x: root(x) for x in prints}


def test_simhash_is_brute_force(docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    roots = closure({f for _, f in rows})
    least = {}
    for d, f in rows:
        if d is not None:
            least[roots[f]] = min(least.get(roots[f], d), d)
    want = Counter((d, f"{f:016x}", least.get(roots[f])) for d, f in rows)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("size", [5, 64, 65, 700])
def test_links_of_groups(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = np.unique(np.concatenate([centre[rng.integers(0, 6, size)] ^ (np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)), rng.integers(0, 1 << 63, size, dtype=np.uint64)]))
    a, b = simhash.group_links(np.zeros(len(prints), np.int64), prints)
    up = {x: x for x in prints.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True):
        up[max(root(x), root(y))] = min(root(x), root(y))
    if size < 700:
        assert {x: root(x) for x in up} == closure(up)
    else:
        for i, x in enumerate(prints):
            for y in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ x) <= 4].tolist():
                assert root(int(x)) == root(y)


def test_large_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT_ROWS", 20)
    rng = np.random.default_rng(3)
    prints = np.unique((np.uint64(0x1234567812345678) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))).view(np.int64))
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    got = components.components(simhash.link(df), "a", "b")
    assert got.count() == len(prints) and got.select("root").distinct().count() == 1


def test_components_of_a_chain(spark):
    edges = spark.range(200).selectExpr("id + 1 AS a", "id AS b").union(spark.sql("SELECT 900L, 950L UNION ALL SELECT NULL, 3L UNION ALL SELECT 7L, 7L"))
    got = {r["node"]: r["root"] for r in components.components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(201)}, 900: 900, 950: 900}
    assert components.components(edges.limit(0), "a", "b").count() == 0


def brute_cut(rows, n):
    """(doc_id, text) -> removed mask, by the windows of documents with a smaller id; null ids come last."""
    big = 1 << 62
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, big + 1), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < (big if d is None else d):
                mask[i : i + n] = True
        out.append((d, b, mask))
    return out


@pytest.mark.parametrize(("length", "q"), [(50, 20), (30, 8)])
def test_substrings_are_brute_force(docs, length, q):
    want = Counter()
    for d, b, mask in brute_cut([(r["doc_id"], r["text"]) for r in docs.collect()], length):
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        want[(d, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, substrings.dedup_report(docs, length, q).collect())) == want


@pytest.mark.parametrize("partitions", ["3", "60"])
def test_a_line_in_every_text(spark, monkeypatch, partitions):
    """Small pages and many partitions change neither the rows nor, beyond a row for each task, what tasks exchange."""
    monkeypatch.setattr(textkit, "PAGE_BYTES", 3000)
    rng = random.Random(8)
    line = "This line, which is longer than fifty bytes, stands in every single text of the table."
    rows = [(i if i % 9 else None, f"{prose(rng, 12)}\n{line}\n{prose(rng, 12)}") for i in range(120)] + [(200 + i, line) for i in range(30)]
    want = Counter((d, int(m.sum())) for d, _, m in brute_cut(rows, 50))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = substrings.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == want


def test_texts_without_repeats(docs):
    want = Counter((d, np.frombuffer(b, np.uint8)[~m].tobytes().decode(errors="ignore")) for d, b, m in brute_cut([(r["doc_id"], r["text"]) for r in docs.collect()], 50))
    got = substrings.dedup_texts(clashing(docs))
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == want and got.columns == clashing(docs).columns


def test_pieces_of_a_very_long_text(monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE", 500)
    monkeypatch.setattr(substrings, "_STEP", 300)
    data = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)
    windows = []
    for _, _, _, first, last in substrings._anchored(data, np.array([0, 3000]), 50, 20):
        windows += [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
    assert sorted(windows) == list(range(2951))


@pytest.mark.parametrize("cut", [5, 10, 100, 422, 800])
def test_damaged_gif(spark, cut):
    whole = gif.write(bytes(range(192)) * 70)
    with pytest.raises(ValueError):
        gif.read(whole[:cut])
    huge = b"GIF89a" + b"\xff\xff\xff\xff" + whole[10:]
    rows = [(1, whole), (2, whole[:cut]), (3, None), (4, b""), (5, huge), (1, whole)]
    got = gif.frames_column(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("frame", F.lit(1))).collect()
    assert [r["doc_id"] for r in got].count(1) == 4 and {r["doc_id"] for r in got if r["error"]} == {2, 5}
    assert not gif.frames_column(spark.createDataFrame([], "doc_id long, media binary")).collect()


def test_ftrl_is_the_textbook_loop():
    """Dictionaries and loops instead of vectors."""
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(1, 8)))), rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2, bits, epochs = 0.5, 1.0, 0.7, 0.5, 6, 3
    z, n, bias = defaultdict(float), defaultdict(float), 1 << bits

    def weight(i):
        penalty = 0.0 if i == bias else l1
        if abs(z[i]) <= penalty:
            return 0.0
        sign = float(np.sign(z[i]))
        return -(z[i] - sign * penalty) / ((beta + n[i] ** 0.5) / alpha + l2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, y = [*rows[k][0].tolist(), bias], rows[k][1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got, intercept = toxicity.ftrl(rows, bits, alpha, beta, l1, l2, epochs)
    assert got.tolist() == pytest.approx([weight(i) for i in range(1 << bits)], abs=1e-6) and intercept == pytest.approx(weight(bias))
    assert 0 < np.count_nonzero(got) < 40


def test_scores_of_toxicity_are_sums_of_distinct_features(spark, docs):
    model = toxicity.fit(docs, labels_for(docs), l1=0.1)
    once = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.count("*").alias("n")).filter("n = 1")
    for r in once.join(toxicity.score(docs, model).select("doc_id", "score"), "doc_id").collect():
        raw = (r["text"] or "").encode()
        _, feats = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.BITS)
        total = model.bias + sum(model.w[f] for f in set(feats.tolist()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-min(60.0, max(-60.0, float(total))))), abs=1e-5)


def test_language_by_sets_of_n_grams(spark):
    """Sets instead of Bloom filters: shares differ by false answers only, which are corrected in expectation."""
    rng = random.Random(12)
    own = {"aa": "kalo miri tesu ponda rika".split(), "bb": "straft drong quilm vext brisk".split(), "cc": "öße üfte äng ßul".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(40)), lang, "s", 0) for i in range(120) for lang in [sorted(own)[i % 3]]]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(df, min_share=0.0)
    low = lambda t: language.lower_letters(np.frombuffer(t.encode(), np.uint8)).tobytes()
    grams = lambda t: [low(t)[i : i + n] for n in language.ORDERS for i in range(len(low(t)) - n + 1) if b"  " not in low(t)[i : i + n]]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = {lang: {g for i, t, x, _, _ in rows if x == lang and not held(i) for g in grams(t)} for lang in own}
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    for i, t, _, _, _ in rows:
        shares = {lang: sum(g in known[lang] for g in grams(t)) / len(grams(t)) for lang in own}
        assert got[i]["lang_pred"] == max(sorted(shares), key=shares.get)
        assert got[i]["score"] == pytest.approx(max(shares.values()), abs=0.02)


def test_texts_without_spaces_are_not_remembered():
    enc, encoder = encoding(), bpe.Encoder(bpe.load_ranks(), memo=1 << 20)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("0123456789abcdefXYZ中文字") for _ in range(3000))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    for memo in (encoder.words, encoder.led, encoder.first):
        assert memo.used <= memo.size and all(len(k) <= bpe.LONGEST for k in [*memo, *memo.old])


def test_what_is_remembered_is_kept_once_and_shares_the_bytes(monkeypatch):
    """Counts alone, or texts alone, have all bytes of the memo: nothing is merged a second time, and one merge tells words and counts."""
    words = [f"pre{k}token" for k in range(3000)]
    merged = []
    plain = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: merged.append(piece) or plain(piece, ranks))
    ranks = bpe.load_ranks()
    for work in (lambda e: e.count([" " + w for w in words]), lambda e: e.encode("a " + " ".join(w.replace("0", "x") for w in words))):
        encoder, _ = bpe.Encoder(ranks, memo=3 << 20), merged.clear()
        first = work(encoder)
        n = len(merged)
        assert work(encoder) == first and len(merged) == n
        pool = (encoder.words, encoder.led, encoder.first, encoder.sizes)
        assert sum(m.used for m in pool) <= 3 << 20 and not any(m.old for m in pool)


def test_bpe_merges_a_word_between_spaces_and_before_a_comma_once(monkeypatch):
    """What is known between spaces is not merged again as a pre-token, and all ids are those of tiktoken."""
    enc, ranks, merged = encoding(), bpe.load_ranks(), []
    plain = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: merged.append(piece) or plain(piece, ranks))
    encoder = bpe.Encoder(ranks)
    for text in ("a qzxwvut b", "a qzxwvut, b", "so: qzxwvut; qzxwvut's (qzxwvut) qzxwvut42 \n qzxwvut", "it's 's 'sqz don't qz 't  \t x"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    assert merged.count(b" qzxwvut") == 1
    rng, small = random.Random(12), bpe.Encoder(ranks, memo=3000)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "qzx", " ", " ", ", ", "'s", "1", "\n", "é", "..."]) for _ in range(rng.randrange(30)))
        assert np.frombuffer(small.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
    for n in (2, 3, 7, 40, 300):
        for _ in range(60):
            piece = "".join(rng.choice("abeinrst") for _ in range(n))
            assert plain(piece.encode(), ranks) == enc.encode_ordinary(piece)
