"""Operator 5, best-fit packing by a grouping genetic algorithm.

Documents become token ids with an end id; those longer than a sequence are cut so that all pieces but the first are full.
Full pieces are sequences by themselves. The others are dealt into groups of about `group_pieces` pieces, whatever the corpus
size, and each group is packed by `islands` islands: copies of the group with other seeds, each evolving a population of
packings in a task of its own. A packing is a set of bins (the groups of the algorithm). Crossover injects whole well-filled
bins of one parent into the other, removes the bins of that which hold a document twice now, and puts the displaced documents
back by best fit. Between epochs each island receives the elite of its neighbour. The best packing of the islands stands; the
documents of its bins that are not well filled migrate to a last round, in which remainders of many groups meet.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm.bpe import _LOOSE_SPACE, load_ranks
from lodestack.llm.textkit import arrow_map, materialise, release, scratch, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
ROOM = 1024
GROUP_PIECES = 4000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: A bin of at least this share of the room is well filled.
WELL_FILLED = 0.995

_STATE: dict = {}


def _tokenizer(name: str):
    """The worker's tokenizer, a faster one of the same vocabulary for most texts, and a pattern of the texts it isn't for."""
    if name not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        ranks = load_ranks(name.replace(".json", ".tiktoken"))
        assert tok.get_vocab_size(with_added_tokens=False) >= len(ranks)
        # texts that the two may split otherwise: those with the string of a special token, or a space that leads no word
        special = "|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values())
        other = re.compile(f"{special}|{_LOOSE_SPACE.pattern}" if special else _LOOSE_SPACE.pattern, _LOOSE_SPACE.flags)
        _STATE[name] = (tok, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), other)
    return _STATE[name]


def encode_texts(texts: list[str], name: str = TOKENIZER) -> list[bytes]:
    """The ids of each text as bytes of little-endian unsigned 32-bit numbers, as the tokenizer encodes it with add_special_tokens=False
    and all its other settings as they are; so the string of a special token within a text becomes its id.

    Other texts in which each space leads a word are split alike by both tokenizers, so the faster one encodes them; the rest go to the
    tokenizer itself. Nothing is remembered from one text to the next."""
    tok, fast, other = _tokenizer(name)
    slow = lambda t: tok.encode(t, add_special_tokens=False).ids if t else []
    return [np.array(slow(t) if other.search(t) else fast.encode_ordinary(t), "<u4").tobytes() for t in texts]


def pieces(docs: DataFrame, name: str = TOKENIZER, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of docs(doc_id, text); a null text counts as empty, so it is its end id."""
    end = np.array([end_id], "<u4").tobytes()

    def each(b: pa.RecordBatch):
        texts = [t or "" for t in b.column("text").to_pylist()]
        for s in range(0, len(texts), 200):
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encode_texts(texts[s : s + 200], name)):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % room or min(n, room), n + 1, room)]
                for p, (a, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(s + k)
                    piece.append(p)
                    start.append(a)
                    length.append(e - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * e]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, room: int) -> Bins:
    """bins with items added, each to the fullest bin that has the room."""
    free = [room - sum(map(sizes.__getitem__, b)) for b in bins]
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    open_: list[int] = []  # the free sizes that occur, ascending
    for k, f in enumerate(free):
        if f:
            if not by_free[f]:
                insort(open_, f)
            by_free[f].append(k)
    for i in items:
        s = sizes[i]
        at = bisect_left(open_, s)
        if at < len(open_):
            f = open_[at]
            k = by_free[f].pop()
            if not by_free[f]:
                del open_[at]
            bins[k].append(i)
            f -= s
        else:
            k, f = len(bins), room - s
            bins.append([i])
        if f:
            if not by_free[f]:
                insort(open_, f)
            by_free[f].append(k)
    return bins


def fitness(sizes: list[int], bins: Bins, room: int) -> tuple[int, float]:
    """Fewer bins are better, and of equally many those that are fuller or emptier: the fill of the others leaves room."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / room) ** 2 for b in bins)


def crossover(sizes: list[int], into: Bins, giver: Bins, room: int, rng: random.Random) -> Bins:
    """`into` with a random half of the well-filled bins of `giver`."""
    good = [b for b in giver if sum(map(sizes.__getitem__, b)) >= WELL_FILLED * room]
    injected = rng.sample(good, len(good) // 2)
    moved = {i for b in injected for i in b}
    kept, displaced = [list(b) for b in injected], []
    for b in into:
        if moved.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in moved]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(sizes, displaced, kept, room)


def mutate(sizes: list[int], bins: Bins, room: int, rng: random.Random) -> Bins:
    """The least filled bin and a few others are emptied and packed anew."""
    order = sorted(range(len(bins)), key=lambda k: sum(map(sizes.__getitem__, bins[k])))
    out = set(order[:1]) | set(rng.sample(range(len(bins)), min(len(bins), 1 + len(bins) // 50)))
    items = [i for k in out for i in bins[k]]
    items.sort(key=lambda i: (-sizes[i], rng.random()))
    return best_fit(sizes, items, [list(b) for k, b in enumerate(bins) if k not in out], room)


def evolve(sizes: list[int], elite: Bins | None, seed: int, room: int, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best packing of a population after some generations; stops once the packing reaches the lower bound."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // room)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    pool = [best_fit(sizes, order, [], room)] + ([elite] if elite else [])
    while len(pool) < population and len(pool[0]) > bound:
        noise = [s * (1 + rng.random() / 4) for s in sizes]
        pool.append(best_fit(sizes, sorted(order, key=noise.__getitem__, reverse=True), [], room))
    score = {id(b): fitness(sizes, b, room) for b in pool}
    for _ in range(generations):
        pool.sort(key=lambda b: score[id(b)], reverse=True)
        if len(pool[0]) <= bound or len(pool) < 2:
            break
        a, b = pool[0], rng.choice(pool[1:])
        for child in (crossover(sizes, a, b, room, rng), crossover(sizes, b, a, room, rng), mutate(sizes, a, room, rng)):
            score[id(child)] = fitness(sizes, child, room)
            pool.append(child)
        pool.sort(key=lambda b: score[id(b)], reverse=True)
        pool = pool[:population]
    return max(pool, key=lambda b: score[id(b)])


def _pack_groups(rows: DataFrame, room: int, islands: int, epochs: int) -> DataFrame:
    """rows(doc_id, piece, start, length, ids_crc32, grp) with the bin of each in its group, and that bin's free room.

    Each (group, island) is a task's unit of bounded size; between epochs, in the shared folder, its elite goes to the next island."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "grp"]
    ids = rows.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(-1).alias("bin"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, island int, bin int"

    def run(epoch: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            # the order of rows within a group must not depend on the shuffle, else islands and retries see other items
            pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32", "start", "bin"], kind="stable").reset_index(drop=True)
            sizes, elite = pdf["length"].tolist(), None
            if epoch:
                by: dict[int, list[int]] = {}
                for k, b in enumerate(pdf["bin"].tolist()):
                    by.setdefault(b, []).append(k)
                elite = list(by.values())
            best = evolve(sizes, elite, hash((int(pdf["grp"].iloc[0]), int(pdf["island"].iloc[0]), epoch)), room)
            at = np.zeros(len(sizes), np.int32)
            for k, b in enumerate(best):
                at[b] = k
            # the elite is what the neighbour starts from in the next epoch
            return pdf.assign(bin=at, island=((pdf["island"] + 1) % islands).astype("int32"))

        return one

    state = ids
    for epoch in range(epochs):
        before, state = state, materialise(state.groupBy("grp", "island").applyInPandas(run(epoch), schema), f"epoch{epoch}")
        release(before)
    best = state.groupBy("grp", "island").agg(F.max("bin").alias("bins")).groupBy("grp").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    chosen = state.join(best, ["grp", "island"])
    free = chosen.groupBy("grp", "bin").agg((F.lit(room) - F.sum("length")).alias("free"))
    return chosen.join(free, ["grp", "bin"]).select(*columns, "bin", "free")


def pack(docs: DataFrame, name: str = TOKENIZER, room: int = ROOM, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of docs(doc_id, text).

    A null or empty text is one piece of one token, the end id. Repeated rows are packed as often as they come; an empty table
    gives no rows; only doc_id and text are read, so other columns may have any name."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    with scratch(docs.sparkSession) as keep:
        cut = keep(materialise(pieces(docs, name, room, end_id).withColumn("rid", F.monotonically_increasing_id()), "pieces"))
        full = cut.filter(F.col("length") == room)
        part = cut.filter(F.col("length") < room)
        groups = max(1, round(part.count() / group_pieces))
        first = keep(materialise(_pack_groups(part.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups))), room, islands, epochs), "first"))
        well = F.col("free") <= (1 - WELL_FILLED) * room
        done = first.filter(well)
        left = first.filter(~well)
        again = max(1, round(left.count() / group_pieces))
        second = keep(materialise(_pack_groups(left.withColumn("grp", F.pmod(F.xxhash64("grp", "bin"), F.lit(again))), room, islands, epochs), "second"))
    wide = 1 << 16  # a group has fewer bins: they are no more than its pieces
    packed = done.select(*columns, ((F.col("grp") * wide + F.col("bin")) * 4 + 1).alias("sequence_id")).unionByName(second.select(*columns, ((F.col("grp") * wide + F.col("bin")) * 4 + 2).alias("sequence_id")))
    # a sequence holds at most `room` pieces, so the window stays small
    placed = packed.selectExpr("*", "sum(length) over (partition by sequence_id order by length desc, doc_id, piece, ids_crc32, start rows between unbounded preceding and current row) - length as offset")
    alone = full.select(*columns, (F.col("rid") * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*columns, "sequence_id", F.col("offset").cast("long").alias("offset")).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
