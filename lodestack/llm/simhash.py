"""Operator 9, SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Fingerprint: A-Z are lowered, words are runs of bytes other than white space, each shingle of `width` words is hashed by XXH64
with seed 42, and a bit is set if it is set in over half the hashes.

Candidates: with 64 bits cut into `parts` parts, two fingerprints within radius r agree on at least parts - r of them, so they
meet under a key of some parts - r parts: no link is missed. Within a key the comparison is bit-sliced: bit plane p of all
fingerprints lies in one vector; XOR with a shifted plane (small groups) or with the bit of a query (large groups) gives a
difference bit for each pair, and carry-save counters, a plane for each bit of the radius and an overflow, add these up for 64 pairs
in one word.
Blocks in which all pairs have exceeded the radius are abandoned. A task returns a spanning forest of its links, not the pairs;
components then come from star contraction. Exact copies are one fingerprint, merged before anything is compared.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.components import components
from lodestack.llm.textkit import arrow_map, join_hot, materialise, scratch, table

WIDTH = 4
RADIUS = 4
PARTS = 6
#: Groups of up to so many fingerprints are compared by shifts, larger ones query by query.
SMALL = 64
#: Rows of a key beyond which it is cut into pieces, and pairs of pieces become tasks of their own.
SPLIT_ROWS = 40_000
NONE = (1 << 63) - 1


def parts_for(prints: int, radius: int = RADIUS) -> int:
    """How many parts a fingerprint is cut into: PARTS, two more from a thousand million on, so that a key's bits grow with the rows.

    Any number over the radius gives the same links."""
    return max(PARTS if prints < 1 << 30 else PARTS + 2, radius + 2)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """0 for a text without words; a text of fewer words than `width` is one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """docs with its fingerprint as a signed long in a new last column."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(x.encode(), width) if x else 0 for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], [*b.schema.names, name])

    return arrow_map(docs, each, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes, (64, words): bit i of plane p is bit p of fingerprint i."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64)
    out = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def _counters(radius: int, shape: int | tuple[int, ...]) -> list[np.ndarray]:
    """Zero counters with a plane for each bit of the radius, three at least, and one for the overflow."""
    return [np.zeros(shape, np.uint64) for _ in range(max(3, radius.bit_length()) + 1)]


def _add(c: list[np.ndarray], x: np.ndarray) -> None:
    """One difference bit into the counters, 64 pairs in each word; what is carried out of the last plane overflows."""
    for plane in c[:-1]:
        carry = plane & x
        plane ^= x
        x = carry
    c[-1] |= x


def _beyond(c: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the pairs that have more than `radius` differences."""
    more, same = c[-1].copy(), ~c[-1]
    for k in reversed(range(len(c) - 1)):
        if radius >> k & 1:
            same &= c[k]
        else:
            more |= same & c[k]
            same &= ~c[k]
    return more


def _shift_pairs(p: np.ndarray, n: int, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within the radius of the n sorted rows of planes p; last[i] is the last row of i's group."""
    left, right = [], []
    rows = np.arange(n)
    for lag in range(1, int((last - rows).max(initial=0)) + 1):
        ok = np.zeros(p.shape[1] * 64, np.uint8)
        ok[:n] = rows + lag <= last
        valid = np.packbits(ok, bitorder="little").view(np.uint64)
        live = np.flatnonzero(valid)
        far, near = lag // 64, np.uint64(lag % 64)
        c = _counters(radius, len(live))
        width = p.shape[1]
        for k in range(64):
            a = p[k]
            low = np.where(live + far < width, a[np.minimum(live + far, width - 1)], np.uint64(0))
            if near:
                high = np.where(live + far + 1 < width, a[np.minimum(live + far + 1, width - 1)], np.uint64(0))
                low = (low >> near) | (high << (np.uint64(64) - near))
            _add(c, a[live] ^ low)
            if k % 8 == 7:  # abandon the words in which no pair is left
                alive = (~_beyond(c, radius) & valid[live]) != 0
                if not alive.all():
                    live, c = live[alive], [x[alive] for x in c]
                if not len(live):
                    break
        if len(live):
            hits = np.zeros(p.shape[1], np.uint64)
            hits[live] = ~_beyond(c, radius) & valid[live]
            i = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))
            left.append(i)
            right.append(i + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _query_hits(p: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words): bits of the lanes of p within the radius of each query."""
    c = _counters(radius, (len(queries), p.shape[1]))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(p.shape[1])
    for k in range(64):
        bit = ((queries >> np.uint64(k)) & np.uint64(1)) * full
        _add(c, p[k][live][None, :] ^ bit[:, None])
        if k % 16 == 15:
            alive = (~_beyond(c, radius)).any(axis=0)
            if not alive.all():
                live, c = live[alive], [x[:, alive] for x in c]
            if not len(live):
                break
    out = np.zeros((len(queries), p.shape[1]), np.uint64)
    if len(live):
        out[:, live] = ~_beyond(c, radius)
    return out


def _large_group(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that connect all that its links connect: rows that are reached leave the lanes, so a dense group takes one sweep."""
    left, right = [], []
    rest, frontier = np.arange(len(prints)), np.zeros(0, np.int64)
    while len(rest):
        seeds = not len(frontier)
        queries, frontier = (rest[:64], frontier) if seeds else (frontier[:64], frontier[64:])
        bits = np.unpackbits(_query_hits(planes(prints[rest]), prints[queries], radius).view(np.uint8), axis=1, bitorder="little")[:, : len(rest)]
        q, lane = np.nonzero(bits)
        other = queries[q] != rest[lane]
        left.append(queries[q[other]])
        right.append(rest[lane[other]])
        reached = bits.any(axis=0)
        if seeds:
            reached[: len(queries)] = True
            frontier = rest[len(queries) :][reached[len(queries) :]]
        else:
            frontier = np.concatenate([frontier, rest[reached]])
        rest = rest[~reached]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the components of edges a-b."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def group_links(key: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (signed fingerprints) that connect what links within equal keys; key and prints may come in any order."""
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    # small groups side by side, in runs of rows that bound the memory
    member = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    small, last = prints[member], np.repeat(starts + sizes - 1, sizes)[member]
    place = np.flatnonzero(member)
    last = np.searchsorted(place, last)
    at = 0
    while at < len(small):
        end = min(at + (1 << 17), len(small))
        end = int(last[end - 1]) + 1
        i, j = _shift_pairs(planes(small[at:end]), end - at, last[at:end] - at, radius)
        a.append(small[at:end][i])
        b.append(small[at:end][j])
        at = end
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        i, j = _large_group(prints[s : s + n], radius)
        a.append(prints[s : s + n][i])
        b.append(prints[s : s + n][j])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))


def _keys(column: str, parts: int, radius: int) -> F.Column:
    """All keys of a fingerprint: the number of the choice and a hash of the bits of the chosen parts."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(parts), parts - radius)):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), F.col(column).bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.explode(F.array(*keys))


def link(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Star edges (a, b) that connect the distinct fingerprints prints(fp) exactly as links within the radius do."""
    spark = prints.sparkSession
    keyed = prints.select("fp", _keys("fp", parts, radius).alias("k")).select("fp", F.col("k.choice").alias("choice"), F.col("k.bits").alias("bits"))
    counts = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n"))
    large = materialise(counts.filter(F.col("n") > SPLIT_ROWS), "large_keys", light=True)
    if large.isEmpty():
        dealt = keyed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        # pieces 0..m-1 of a large key: each row goes to every pair of pieces that has its own, so all pairs meet, in tasks of two pieces
        m = F.ceil(F.col("n") / (SPLIT_ROWS // 2)).cast("int")
        joined = keyed.join(large, ["choice", "bits"], "left").withColumn("m", F.coalesce(m, F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        dealt = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("fp", "choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.select("fp", F.xxhash64("choice", "bits", "i", "j").alias("key")).repartition(shuffles, "key")

    def run(batches):
        keys, values = [], []
        for b in batches:
            keys.append(b.column("key").to_numpy())
            values.append(b.column("fp").to_numpy().view(np.uint64))
        if keys:
            x, y = group_links(np.concatenate(keys), np.concatenate(values), radius)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, total: int, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """(fp, root, component, n), materialised: of each fingerprint of prints(fp, rank), a fingerprint that stands for its component, the
    smallest rank in that, and the rows of the fingerprint."""
    with scratch(prints.sparkSession) as keep:
        own = materialise(prints.groupBy("fp").agg(F.min("rank").alias("least"), F.count("*").alias("n")), "prints", light=True)
        found = components(link(own.select("fp"), radius, parts or parts_for(total, radius)), "a", "b")
        rooted = materialise(own.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted", light=True)
        groups = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
        return keep(materialise(join_hot(rooted, groups, ["root"], "members", total).select("fp", "root", "component", "n"), "classes", light=True))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links, null only if all of the component are null. Null, empty and
    white-space texts have fingerprint zero, and link with each other. Rows that repeat share a component; an empty table
    gives no rows; only doc_id and text are read, so other columns may have any name."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text"), "fp", width).select("doc_id", "fp", F.coalesce("doc_id", F.lit(NONE)).alias("rank")), "fingerprints")
    total = prints.count()
    found = join_hot(prints.select("doc_id", "fp"), classes(prints.select("fp", "rank"), total, radius, parts), ["fp"], "n", total)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("component"), F.lit(NONE)).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
