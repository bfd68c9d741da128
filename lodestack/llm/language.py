"""Operator 8, language ID: bit-sliced Bloom filters of n-grams of UTF-8 bytes.

One table of 2**slots_log2 cells holds a bitmask of languages per cell, so column l of the table is the Bloom filter of
language l and one look-up (the AND of `hashes` cells) returns all languages that contain an n-gram. For each text the bits
are summed by language; a filter whose slice is filled to phi answers falsely with probability phi**hashes, which is taken
off: (count - n f) / (1 - f). The language with the largest corrected share wins.

The filter of a language holds each n-gram that makes up at least `min_share` of the n-grams of its order in that language's
training rows: at most 1 / min_share per language and order, whatever the corpus, which bounds what is collected and sent. With a
min_share of 0 it holds all of them, as many as the sample has.

n-grams are taken of bytes, so the orders 2 to 4 span one to four letters: the letters of a script of its own tell a language by
themselves, and Latin letters tell one by their sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.textkit import BLOCK_BYTES, arrow_map, blocks, held_out, lower_letters, mix, slices, table, utf8

ORDERS = (2, 3, 4)
#: Bound of the training sample, in rows per language (in expectation).
TRAIN_ROWS = 4000
UNDETERMINED = "und"
#: n-grams that a task counts before it hands their counts on.
MOST_COUNTS = 200_000


@dataclass
class Model:
    langs: list[str]
    cells: np.ndarray  # unsigned ints, one bit per language, 64 languages per word: shape (words, 2**slots_log2)
    false_rate: np.ndarray  # per language
    hashes: int = 2


def _grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that starts at each byte, and whether it has a letter and no two spaces side by side."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    space = data == 32
    two = space[:-1] & space[1:]
    bad = np.zeros(m, bool)
    for k in range(n - 1):
        bad |= two[k : k + m]
    packed = data[:m].astype(np.uint64)
    for k in range(1, n):
        packed |= data[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    return mix(packed | np.uint64(n << 56)), ~bad


def _within(off: np.ndarray, n: int, size: int) -> np.ndarray:
    """The row of the n-gram at each byte, or -1 where it would cross into the next row."""
    m = max(0, size - n + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:m]
    return np.where(np.arange(m) + n <= off[1:][row], row, -1) if m else row


def _pieces(data: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(i, j, offsets, letters, starts) of blocks of rows [i, j). A row of over `limit` bytes comes in pieces that overlap by less than an
    n-gram; those n-grams of a piece count that begin before `starts`, so each counts once and the work on a row takes bounded memory."""
    for i, j in blocks(off, limit):
        low = lower_letters(data[off[i] : off[j]])
        if j - i > 1 or len(low) <= limit:
            yield i, j, off[i : j + 1] - off[i], low, len(low)
            continue
        for s in range(0, len(low), limit):
            part = low[s : s + limit + max(ORDERS) - 1]
            yield i, j, np.array([0, len(part)]), part, limit if s + limit < len(low) else len(part)


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text): all training rows of a language that has up to `rows`, and of another one those whose hash falls in the
    fraction that makes up `rows` in expectation. Held-out rows, null languages and null texts never count."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).collect()
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, rows / r["n"])))) if counts else F.create_map(F.lit(""), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return able.filter(draw < share[F.col("lang")]).select("lang", "text")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, min_share: float = 2e-5, slots_log2: int = 20, hashes: int = 2, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learn the filters from text and lang of the rows that are not held out."""

    def partial(seen):
        for (lang, n), grams in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "n": pa.array([n] * len(grams), pa.int32()), "gram": pa.array(np.fromiter(grams.keys(), np.uint64, len(grams)).view(np.int64)), "count": pa.array(list(grams.values()), pa.int64())})

    def count(batches):
        seen: dict[tuple[str, int], dict[int, int]] = {}
        for b in batches:
            if sum(map(len, seen.values())) > MOST_COUNTS:
                yield from partial(seen)
                seen = {}
            data, off = utf8(b.column("text"))
            langs = b.column("lang").to_pylist()
            for i, j, o, low, starts in _pieces(data, off):
                names = sorted(set(langs[i:j]))
                own = np.array([names.index(x) for x in langs[i:j]])
                for n in orders:
                    h, ok = _grams(low, n)
                    row = _within(o, n, len(low))
                    ok &= row >= 0
                    ok[starts:] = False
                    for k in range(len(names)):
                        mine = h[ok & (own[np.maximum(row, 0)] == k)] if len(h) else h
                        keys, counts = np.unique(mine, return_counts=True)
                        into = seen.setdefault((names[k], n), {})
                        for g, c in zip(keys.tolist(), counts.tolist(), strict=True):
                            into[g] = into.get(g, 0) + c
        yield from partial(seen)

    counts = sample(docs, rows).mapInArrow(lambda batches: count(x for b in batches for x in slices(b)), "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    total = Window.partitionBy("lang", "n")
    kept = counts.withColumn("all", F.sum("count").over(total)).filter(F.col("count") >= F.col("all") * min_share)
    got = kept.select("lang", "gram").toPandas()
    langs = sorted(got["lang"].unique().tolist())
    cells = np.zeros((max(1, -(-len(langs) // 64)), 1 << slots_log2), np.uint64)
    fill = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        gram = got["gram"][got["lang"] == lang].to_numpy().view(np.uint64)
        for at in _places(gram, slots_log2, hashes):
            cells[k // 64, at] |= np.uint64(1 << (k % 64))
        fill[k] = np.count_nonzero(cells[k // 64] & np.uint64(1 << (k % 64))) / (1 << slots_log2)
    if len(langs) <= 8:
        cells = cells.astype(np.uint8)
    return Model(langs, cells, fill**hashes, hashes)


def _places(gram: np.ndarray, slots_log2: int, hashes: int) -> list[np.ndarray]:
    mask = np.uint64((1 << slots_log2) - 1)
    return [((gram >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(hashes)]


def score_batch(model: Model, column: pa.Array, orders: tuple[int, ...] = ORDERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, corrected share of its n-grams (0 to 1) and lead over the second language, for each text."""
    data, off = utf8(column)
    n_rows, n_langs = len(off) - 1, len(model.langs)
    slots_log2 = int(np.log2(model.cells.shape[1]))
    known, seen, ascii_letter = np.zeros((n_rows, n_langs)), np.zeros(n_rows), np.zeros(n_rows, bool)
    few = model.cells.dtype == np.uint8
    bits = (np.arange(256)[:, None] >> np.arange(n_langs)[None, :]) & 1 if few else None
    for i, j, o, low, starts in _pieces(data, off):
        rows = j - i
        letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int32)])
        ascii_letter[i:j] |= letters[o[1:]] > letters[o[:-1]]
        for n in orders:
            h, ok = _grams(low, n)
            row = _within(o, n, len(low))
            ok &= row >= 0
            ok[starts:] = False
            h, row = h[ok], row[ok]
            if not len(h):
                continue
            seen[i:j] += np.bincount(row, minlength=rows)
            places = _places(h, slots_log2, model.hashes)
            for word in range(len(model.cells)):
                found = model.cells[word][places[0]]
                for p in places[1:]:
                    found &= model.cells[word][p]
                if few:
                    known[i:j] += np.bincount((row << 8) | found, minlength=rows << 8).reshape(rows, 256) @ bits
                else:
                    for k in range(word * 64, min(n_langs, word * 64 + 64)):
                        has = (found >> np.uint64(k % 64)) & np.uint64(1)
                        known[i:j, k] += np.bincount(row, weights=has, minlength=rows)
    share = np.clip((known - seen[:, None] * model.false_rate) / (1 - model.false_rate), 0, None) / np.maximum(seen, 1)[:, None]
    if not n_langs:
        return [UNDETERMINED] * n_rows, np.zeros(n_rows), np.zeros(n_rows)
    order = np.argsort(-share, axis=1, kind="stable")
    best = order[:, 0]
    top = np.minimum(share[np.arange(n_rows), best], 1.0)
    second = share[np.arange(n_rows), order[:, 1]] if n_langs > 1 else np.zeros(n_rows)
    out: list[str] = [model.langs[k] for k in best]
    for r in np.flatnonzero(~ascii_letter):  # hardly any text: look for a letter of another script
        if not any(c.isalpha() for c in column[int(r)].as_py() or ""):
            out[r], top[r], second[r] = UNDETERMINED, 0.0, 0.0
    return out, top, np.clip(top - second, 0, 1)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lead for every row of docs(doc_id, text).

    `und` with score 0 if the text is null, empty or has no letter. Repeated rows give repeated results; an empty table
    gives none; only doc_id and text are read, so other columns may have any name; ties go to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**slots_log2 cells and the names: a fixed size

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, lead = score_batch(shared.value, b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held"), pa.array(lang, pa.string()), pa.array(score), pa.array(lead)], ["doc_id", "held_out", "lang_pred", "score", "lead"])

    return arrow_map(docs.select("doc_id", held_out().alias("held"), "text"), each, "doc_id long, held_out boolean, lang_pred string, score double, lead double")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.2) -> DataFrame:
    """The rows of docs, all columns, whose language is known: not `und`, and at least min_score of the n-grams belong to it. A string
    column `lang`, if there, holds the language found from then on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, _ = score_batch(shared.value, b.column("text"))
        columns = list(b.columns)
        if at is not None:
            columns[at] = pa.array(lang, pa.string())
        known = (np.array(lang, object) != UNDETERMINED) & (score >= min_score)
        return pa.RecordBatch.from_arrays(columns, b.schema.names).filter(pa.array(known.astype(bool)))

    return arrow_map(docs, each, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
