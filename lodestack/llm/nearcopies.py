"""Operator 9 at a similarity: one document of each component of pairs whose shingle sets have a Jaccard similarity of `least` or more.

A-Z are lowered, words are runs of bytes other than white space, a document is its set of XXH64 hashes of `width` words. Equal sets
are one document, merged before anything is compared. A set's SimHash fingerprint has WORDS times 64 bits: two sets of similarity s
differ in a share acos(2s / (1 + s)) / pi of them, 0.15 at 0.8, unrelated ones in half.

Candidates: 64 bits within 24 leave no keys that must agree, so keys are drawn instead, each of some bits of the fingerprint; as many
that a pair of similarity `least` shares none in one of 10,000 cases, by calculation. Within a key the first 64 bits are compared
bit-sliced, as in simhash: bit planes, carry-save counters, abandoned words. What is within their radius, and within that of the first
192 bits, is a candidate; unrelated sets hardly ever are. What the first few keys link gets a common label, and later keys return links
between labels only: a set of many near copies is named by a few keys, not again by each. Components of candidates are cut into
blocks, compared bit-sliced again, and what is left there is decided by its exact similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import components
from lodestack.llm.simhash import NONE, SPLIT_ROWS, _forest, _query_hits, _shift_pairs, planes
from lodestack.llm.textkit import load_page, materialise, mix, pages, release, scratch

WIDTH = 5
LEAST = 0.8
#: 64-bit words of a fingerprint, and how many of them are compared.
WORDS = 8
COMPARED = 3
#: Share of pairs of similarity `least` that may share no key.
MISS = 1e-4
#: Keys whose links are followed to labels before the other keys are looked at.
FIRST = 8
#: Keys of a fingerprint that are dealt out at a time, bounding the disk, unless all rows with them are few.
ROUND = 32
ROUND_ROWS = 4_000_000
#: Rows of a task that compares within keys, about; and of a key's group up to which it is compared by shifts, not query by query.
TASK_ROWS = 1_000_000
SMALL = 128
#: Differing bits beyond which a pair isn't looked at: sets of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 24
#: Sets with fewer shingles than this have ragged fingerprints: they have twice the keys, and in a block are always looked at.
FEW = 32
#: Documents of a block beyond which it is cut into pieces, and pairs of pieces become tasks of their own.
PIECE = 500
_XOR = np.random.default_rng(42).integers(0, 1 << 64, WORDS, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; none for a text without words, one for a text of fewer words than `width`."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - width + 1)].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set in WORDS words: each hash is mixed anew for each word, and a bit is set if it is in over half of them."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # counts of so many fit a byte
        mixed = mix(hashes[at : at + 255, None] ^ _XOR)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def differing(least: float) -> float:
    """The share of bits in which sets of similarity `least` differ, and a little for ties in even numbers of hashes."""
    return math.acos(min(1.0, 2 * least / (1 + least))) / math.pi + 0.005


def reach(bits: int, least: float, deviations: float) -> int:
    """A radius over so many bits: what sets of similarity `least` differ in, and some standard deviations."""
    d = differing(least)
    return int(bits * d + deviations * math.sqrt(bits * d * (1 - d)))


def key_shape(total: int, least: float) -> tuple[int, int]:
    """Bits of a key, growing with the sets so that keys hold about 100, and the number of keys that misses a share of MISS."""
    width, d, n = max(14, total.bit_length() - 7), differing(least), 64 * WORDS
    log = [0.0, *np.cumsum(np.log(np.arange(1, n + 1))).tolist()]
    far = np.arange(n - width + 1)  # differing bits of a pair; of those beyond, no key is shared
    odds = np.array([math.exp(log[n] - log[x] - log[n - x] + x * math.log(d) + (n - x) * math.log1p(-d)) for x in far])
    apart = np.array([1 - math.exp(log[n - x] - log[n - x - width] + log[n - width] - log[n]) for x in far])
    keys = 1
    while (odds * apart**keys).sum() + max(0.0, 1 - odds.sum()) > MISS:
        keys += max(1, keys // 50)
    return width, keys


def key_bits(width: int, first: int, last: int) -> np.ndarray:
    """(keys, width): the bits of keys first..last-1, drawn by the number of the key."""
    return np.array([np.random.default_rng([42, k]).choice(64 * WORDS, width, replace=False) for k in range(first, last)])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set: a bit is set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_sets(stored: DataFrame, width: int = WIDTH) -> DataFrame:
    """(page, row, rank, fp, few, signs) of every row of pages(): a hash of its set, 0 for an empty one, whether it has fewer than FEW
    shingles, its long fingerprint, none for an empty one, and its doc_id, a null one after all others."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, z in zip(b.column("page").to_pylist(), b.column("z").to_pylist(), strict=True):
                docs = load_page(z)
                ranks = pc.fill_null(docs.column("doc_id").cast(pa.int64()), NONE)
                for s in range(0, docs.num_rows, 1000):
                    sets = [shingles((x or "").encode(), width) for x in docs.column("text").slice(s, 1000).to_pylist()]
                    prints = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), 7) if len(x) else 0 for x in sets), np.uint64, len(sets)).view(np.int64)
                    few = pa.array([len(x) < FEW for x in sets], pa.bool_())
                    signs = pa.array([long_fingerprint(x).view(np.int64) if len(x) else [] for x in sets], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([page] * len(sets), pa.int64()), pa.array(np.arange(s, s + len(sets), dtype=np.int32)), ranks.slice(s, 1000), pa.array(prints), few, signs], ["page", "row", "rank", "fp", "few", "signs"])

    return stored.mapInArrow(each, "page long, row int, rank long, fp long, few boolean, signs array<long>")


def _alike(signs: np.ndarray, i: np.ndarray, j: np.ndarray, within: int) -> np.ndarray:
    """Which pairs of rows differ in at most `within` bits of all words."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 18):
        part = slice(at, at + (1 << 18))
        out[part] = np.bitwise_count(signs[i[part]] ^ signs[j[part]]).sum(axis=1, dtype=np.int64) <= within
    return out


def _dense(signs: np.ndarray, labels: np.ndarray, radius: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that connect all that its pairs and labels connect: rows that are reached leave, with all of their label, so
    many near copies take one sweep."""
    left, right = [], []
    rest, frontier = np.arange(len(signs)), np.zeros(0, np.int64)
    while len(rest):
        if not len(frontier):
            own = labels[rest] == labels[rest[0]]
            frontier, rest = rest[own], rest[~own]
        queries, frontier = frontier[:64], frontier[64:]
        if not len(rest):
            continue
        bits = np.unpackbits(_query_hits(planes(signs[rest, 0]), signs[queries, 0], radius).view(np.uint8), axis=1, bitorder="little")[:, : len(rest)]
        q, lane = np.nonzero(bits)
        ok = _alike(signs, queries[q], rest[lane], within)
        q, lane = q[ok], lane[ok]
        lane, at = np.unique(lane, return_index=True)  # one link reaches a row
        left.append(queries[q[at]])
        right.append(rest[lane])
        own = np.isin(labels[rest], labels[rest[lane]])
        frontier, rest = np.concatenate([frontier, rest[own]]), rest[~own]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def key_links(key: np.ndarray, labels: np.ndarray, signs: np.ndarray, radius: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of labels that connect the rows of equal keys that are within `radius` bits in the first word of signs, compared
    bit-sliced, and within `within` bits in all of them. Rows of one label are linked already: these links aren't returned, and keys that
    have no other label aren't looked at."""
    order = np.lexsort((labels, key))
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        sizes = np.diff(np.append(first, len(order)))
        order = order[np.repeat(labels[order[first]] != labels[order[first + sizes - 1]], sizes)]
    key, left, right = key[order], [], []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    # groups side by side, largest first, so that long shifts meet few words; in runs of rows that bound the memory
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    small = small[np.argsort(-sizes[small], kind="stable")]
    ends = np.cumsum(sizes[small])
    rows = order[np.repeat(starts[small] - (ends - sizes[small]), sizes[small]) + np.arange(ends[-1] if len(ends) else 0)]
    last = np.repeat(ends - 1, sizes[small])
    at = 0
    while at < len(rows):
        end = int(last[min(at + (1 << 16), len(rows)) - 1]) + 1
        mine = rows[at:end]
        i, j = _shift_pairs(planes(signs[mine, 0]), end - at, last[at:end] - at, radius)
        ok = _alike(signs, mine[i], mine[j], within)
        left.append(labels[mine[i[ok]]])
        right.append(labels[mine[j[ok]]])
        at = end
    for k in np.flatnonzero(sizes > SMALL):
        mine = order[starts[k] : starts[k] + sizes[k]]
        i, j = _dense(signs[mine], labels[mine], radius, within)
        left.append(labels[mine[i]])
        right.append(labels[mine[j]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def _linked_by_keys(own: DataFrame, total: int, width: int, first: int, last: int, least: float) -> DataFrame:
    """Star edges (a, b) of labels that connect the sets own(fp, label, signs) that are alike and share one of the keys first..last-1; an
    edge may come from several tasks."""
    compared = [f"s{k}" for k in range(COMPARED)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, weights = key_bits(width, first, last), np.int64(1) << np.arange(width, dtype=np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                n = part.num_rows
                signs = part.column("signs").flatten().to_numpy().reshape(n, WORDS)
                ones = np.unpackbits(signs.view(np.uint8), axis=1, bitorder="little")
                keys = (ones[:, bits] * weights).sum(axis=2) | (np.arange(first, last, dtype=np.int64) << 40)
                again = last - first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *(np.repeat(part.column(c).to_numpy(), again) for c in ("fp", "label")), *(np.repeat(signs[:, k], again) for k in range(COMPARED)))], ["key", "fp", "label", *compared])

    rows = own.select("fp", "label", "signs").mapInArrow(keyed, ", ".join(f"{c} long" for c in ["key", "fp", "label", *compared]))
    dealt = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if total > SPLIT_ROWS:
        large = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_ROWS), "large_keys", light=True)
        if not large.isEmpty():
            # pieces 0..m-1 of a large key: each row goes to every pair of pieces that has its own, as in simhash.link
            m = F.coalesce(F.ceil(F.col("n") / (SPLIT_ROWS // 2)).cast("int"), F.lit(1))
            joined = rows.join(large, "key", "left").withColumn("m", m).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
            dealt = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * (last - first) // TASK_ROWS))
    grouped = dealt.select(F.xxhash64("key", "i", "j").alias("key"), "label", *compared).repartition(tasks, "key")
    radius, within = reach(64, least, 5), reach(64 * COMPARED, least, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("key", "label", *compared)] for b in batches]
        if parts:
            key, labels, *signs = (np.concatenate(x) for x in zip(*parts, strict=True))
            x, y = key_links(key, labels, np.stack(signs, axis=1).view(np.uint64), radius, within)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def candidates(own: DataFrame, least: float) -> DataFrame:
    """(node, root) of each set of own(fp, few, signs), one row a set, that is linked to another by their fingerprints."""
    total, few = own.agg(F.count("*"), F.count_if("few")).first()
    width, keys = key_shape(total, least)
    links = lambda *of: materialise(_linked_by_keys(*of, least).distinct(), "alike", light=True)
    begun = links(own.withColumn("label", F.col("fp")), total, width, 0, min(FIRST, keys))
    stars = components(begun, "a", "b")
    labelled = materialise(own.join(stars.select(F.col("node").alias("fp"), F.col("root").alias("label")), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled", light=True)
    rounds = []
    for sets, n, start, end in ((labelled, total, FIRST, keys), (labelled.filter("few"), few, keys, 2 * keys)):
        step = max(ROUND, ROUND_ROWS // max(1, n))
        rounds += [(sets, n, width, k, min(k + step, end)) for k in range(start, end, step) if n]
    found = [links(*of) for of in rounds]
    joined = components(reduce(DataFrame.union, found, stars.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
    release(begun, labelled, *found)
    return joined


def set_links(prints: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what pairs of similarity `least` or more connect; rows that are reached leave, so many copies take one sweep."""
    order = np.unique(prints, return_index=True)[1]
    prints, sets = prints[order], [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    mine = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    signs = np.array([set_fingerprint(s) for s in sets], np.uint64)
    sliced = planes(signs) if len(sets) else None
    has = np.zeros(int(flat.max(initial=-1)) + 1, np.int64)
    left, right, frontier = [], [], []
    rest = np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not rest[seed]:
            continue
        rest[seed] = False
        frontier.append(seed)
        while frontier:
            q = frontier.pop()
            able = rest & (np.minimum(sizes, sizes[q]) >= least * np.maximum(sizes, sizes[q]) - 1e-9)
            if sizes[q] >= FEW and able.any():
                close = np.unpackbits(_query_hits(sliced, signs[q : q + 1], RADIUS).view(np.uint8), bitorder="little")[: len(sets)] > 0
                able &= close | (sizes < FEW)
            near = np.flatnonzero(able)
            if not len(near):
                continue
            has[mine[q]] = 1
            both = np.add.reduceat(has[np.concatenate([mine[k] for k in near])], np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            has[mine[q]] = 0
            hit = near[both >= least * (sizes[near] + sizes[q] - both) - 1e-9]
            left.append(np.full(len(hit), prints[q]))
            right.append(prints[hit])
            rest[hit] = False
            frontier += hit.tolist()
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def _rows_of_pages(keys: DataFrame, *columns: str) -> DataFrame:
    """(page, wanted): the rows of each page that keys has, with the named columns, in the order of rows; a page bounds them."""
    return keys.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row", *columns))).alias("wanted"))


def links(stored: DataFrame, keys: DataFrame, firsts: DataFrame, width: int, least: float) -> DataFrame:
    """Star edges (a, b) of fingerprints that connect the documents whose sets are alike; firsts has a row (fp, page, row) for each of these."""
    shuffles = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = materialise(keys.filter(F.size("signs") > 0).join(firsts, ["fp", "page", "row"], "left_semi").select("fp", "few", "signs"), "signs", light=True)
    found = candidates(own, least)
    release(own)
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    cut = sizes.filter(F.col("n") > PIECE).select("root", F.ceil(F.col("n") / (PIECE // 2)).cast("int").alias("m"))
    dealt = found.join(cut, "root", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    placed = dealt.select(F.col("node").alias("fp"), "root", "m", "own").join(firsts, "fp")
    wanted = stored.join(_rows_of_pages(placed, "fp", "root", "m", "own").hint("shuffle_hash"), "page")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, rows in zip(b.column("z").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                texts = load_page(z).column("text")
                for s in range(0, len(rows), 500):
                    part = rows[s : s + 500]
                    sets = [shingles((texts[r["row"]].as_py() or "").encode(), width).tobytes() for r in part]
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in part], t) for c, t in (("fp", pa.int64()), ("root", pa.int64()), ("m", pa.int32()), ("own", pa.int32()))), pa.array(sets, pa.binary())], ["fp", "root", "m", "own", "hashes"])

    sets = wanted.select("z", "wanted").mapInArrow(hashed, "fp long, root long, m int, own int, hashes binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    grouped = pairs.select("fp", "hashes", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(shuffles, "root", "i", "j")

    def compare(group: pa.Table) -> pa.Table:
        a, b = set_links(group.column("fp").to_numpy(), [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()], least)
        return pa.table({"a": a, "b": b})

    return grouped.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row of docs, all columns, for each component of documents of similarity `least` or more: that with the smallest doc_id, any
    one of those that share this. Texts without words are alike; an empty table gives no rows; other columns may have any name."""
    with scratch(docs.sparkSession) as keep:
        stored = keep(pages(docs))
        keys = materialise(with_sets(stored, width), "sets")
        own = materialise(keys.groupBy("fp").agg(F.min(F.struct("rank", "page", "row")).alias("first")), "firsts", light=True)
        found = components(links(stored, keys, own.select("fp", "first.page", "first.row"), width, least), "a", "b")
        rooted = own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        best = keep(materialise(_rows_of_pages(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.page", "first.row")), "best", light=True))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, rows in zip(b.column("z").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                yield load_page(z).take(pa.array([r["row"] for r in rows], pa.int64()))

    return stored.join(best.hint("shuffle_hash"), "page").select("z", "wanted").mapInArrow(chosen, docs.schema)
