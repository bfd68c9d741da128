"""Operator 6, edit-aware token counts: a segment tree over the pre-tokens of each document.

Leaves hold runs of pre-tokens with their lengths and token counts; inner nodes hold the sums. An edit finds its leaves by
descending over the lengths, matches pre-tokens anew from a little before the edit until a boundary falls on an old one (from
there on all is as before, for a match depends only on what follows its start), encodes only these, and updates the sums on the
paths of the leaves it touched.

How far back: a match looks past its own end only over white space that a word may take the last of, or over the letters of a
contraction. So the match starts anew three pre-tokens before the edit, and before any white space there.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.bpe import _ANY, RANKS, Encoder, _state, pre_tokens
from lodestack.llm.textkit import arrow_map, table

LEAF = 32
BACK = 3


class CountTree:
    """The token count of a text under edits."""

    def __init__(self, text: str, encoder: Encoder, lens: list[int] | None = None, counts: list[int] | None = None):
        """lens and counts, as state() gave them for the same text, spare the encoding."""
        self.text, self.encoder = text, encoder
        self.encoded = self.nodes = 0
        if lens is None or counts is None:
            pieces = pre_tokens(text)
            lens, counts = list(map(len, pieces)), encoder.count(pieces)
        self._build(lens, counts)

    def _build(self, lens: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lens) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [(lens[k * LEAF : (k + 1) * LEAF], counts[k * LEAF : (k + 1) * LEAF]) for k in range(self.size)]
        self.chars = [0] * self.size + [sum(x[0]) for x in self.leaves]
        self.tokens = [0] * self.size + [sum(x[1]) for x in self.leaves]
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def __len__(self) -> int:
        return self.tokens[1]

    def state(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]

    def before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character `at`."""
        leaf, start, total = self._leaf(at)
        for n, c in zip(*self.leaves[leaf], strict=True):
            if start + n > at:
                break
            start, total = start + n, total + c
        return total

    def _leaf(self, at: int) -> tuple[int, int, int]:
        """The leaf that holds character `at` (the last one for the end), its first character and the tokens before it."""
        k, start, total = 1, 0, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= at and self.chars[k + 1]:
                start, total = start + self.chars[k], total + self.tokens[k]
                k += 1
        return k - self.size, start, total

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Replace text[start:start+length]; both are cut to the text. Returns the new count."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(start + max(length, 0), len(old))
        self.text = new = old[:start] + replacement + old[end:]
        shift = len(new) - len(old)
        first, at, _ = self._leaf(start)
        # boundaries from some pre-tokens before the edit on, taken from whole leaves
        while True:
            bounds = list(accumulate(self.leaves[first][0], initial=at))
            inside = [b for b in bounds if b < start]
            k = len(inside) - BACK
            while k > 0 and old[inside[k] - 1 : inside[k]].isspace():
                k -= 1
            if k > 0 or first == 0:
                k = max(k, 0)
                break
            first -= 1
            at -= self.chars[self.size + first]
        # more leaves join as the scan passes them, until it meets an old boundary behind the edit
        last, stop = first, at + self.chars[self.size + first]
        places = {b: i for i, b in enumerate(bounds)}
        lens: list[int] = []
        counts: list[int] = []
        pos, size = bounds[k], self.encoder.size
        seen = len(self.leaves[first][0])
        meet = None
        if pos >= len(new) and end == len(old):
            meet = len(places) - 1 if stop == len(old) else None
        for m in _ANY.finditer(new, pos):
            piece = m.group()
            lens.append(len(piece))
            counts.append(size(piece))
            pos = m.end()
            was = pos - shift
            if pos < start + len(replacement) or was < end:
                continue
            while was > stop and last + 1 < self.size:
                last += 1
                for n in self.leaves[last][0]:
                    stop += n
                    seen += 1
                    places[stop] = seen
            if was in places:
                meet = places[was]
                break
        self.encoded += len(lens)
        own = [x for leaf in self.leaves[first : last + 1] for x in leaf[0]], [x for leaf in self.leaves[first : last + 1] for x in leaf[1]]
        if meet is None:  # the scan ran to the end of the text
            last, meet = self.size - 1, sum(len(x[0]) for x in self.leaves[first:])
            own = [x for leaf in self.leaves[first:] for x in leaf[0]], [x for leaf in self.leaves[first:] for x in leaf[1]]
        merged = own[0][:k] + lens + own[0][meet:], own[1][:k] + counts + own[1][meet:]
        span = last - first + 1
        if len(merged[0]) > 4 * LEAF * span:
            whole = [(self.leaves[j]) for j in range(self.size)]
            whole[first : last + 1] = [merged]
            self._build([x for a, _ in whole for x in a], [x for _, b in whole for x in b])
            self.nodes += 2 * self.size
            return len(self)
        each = -(-len(merged[0]) // span) if merged[0] else 0
        dirty = set()
        for j in range(span):
            part = merged[0][j * each : (j + 1) * each], merged[1][j * each : (j + 1) * each]
            self.leaves[first + j] = part
            leaf = self.size + first + j
            self.chars[leaf], self.tokens[leaf] = sum(part[0]), sum(part[1])
            dirty.add(leaf >> 1)
        self.nodes += span
        while dirty and dirty != {0}:
            for j in dirty:
                self.chars[j] = self.chars[2 * j] + self.chars[2 * j + 1]
                self.tokens[j] = self.tokens[2 * j] + self.tokens[2 * j + 1]
            self.nodes += len(dirty)
            dirty = {j >> 1 for j in dirty} - {0}
        return len(self)


_COLUMNS = "doc_id long, n_tokens long, n_edits int, n_tokens_edited long, n_chars_edited long, edited_sha256 string, pretokens_encoded long, nodes_updated long"


def count_edited(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """Counts before and after the edits of every row of docs(doc_id, text, edits array<struct<start int, length int, replacement string>>).

    Edits apply one after another, each to what the last one left, positions in characters, cut to the text. A null text counts as
    empty, null edits as none, a null replacement as a deletion. Repeated rows give repeated results, an empty table none; other
    columns may have any name."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _state(name)[0]
        rows = []
        for k in range(b.num_rows):
            tree = CountTree(b.column("text")[k].as_py() or "", encoder)
            n, edits = len(tree), b.column("edits")[k].as_py() or []
            for e in edits:
                tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            rows.append((n, len(edits), len(tree), len(tree.text), hashlib.sha256(tree.text.encode()).hexdigest(), tree.encoded, tree.nodes))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [f.split()[0] for f in _COLUMNS.split(", ")])

    return arrow_map(docs.select("doc_id", "text", "edits"), each, _COLUMNS)


def trees(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, text, lens, counts: the leaves of each document's tree, to be kept as a table."""

    def each(b: pa.RecordBatch):
        encoder = _state(name)[0]
        texts = b.column("text").to_pylist()
        for s in range(0, len(texts), 200):
            states = [CountTree(t or "", encoder).state() for t in texts[s : s + 200]]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, 200), b.column("text").slice(s, 200), pa.array([x[0] for x in states], kind), pa.array([x[1] for x in states], kind)], ["doc_id", "text", "lens", "counts"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, text string, lens array<int>, counts array<int>")


def apply_edits(kept: DataFrame, edits: DataFrame, name: str = RANKS) -> DataFrame:
    """The table of trees after edits(doc_id, number, start, length, replacement), in the order of number; nothing but what the edits
    touch is encoded. Edits of unknown documents are ignored."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "start", "length", "replacement"))).alias("edits"))

    def each(b: pa.RecordBatch):
        encoder = _state(name)[0]
        out = []
        for k in range(b.num_rows):
            tree = CountTree(b.column("text")[k].as_py() or "", encoder, b.column("lens")[k].as_py(), b.column("counts")[k].as_py())
            for e in b.column("edits")[k].as_py() or []:
                tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
            out.append((tree.text, *tree.state()))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], kind)], ["doc_id", "text", "lens", "counts"])

    return arrow_map(kept.join(listed, "doc_id", "left").select("doc_id", "text", "lens", "counts", "edits"), each, "doc_id long, text string, lens array<int>, counts array<int>")


def usual_edits() -> F.Column:
    """Four edits that depend on the length of the text alone: an insertion, a deletion, a replacement and an addition at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, size, new: F.struct(at.cast("int").alias("start"), F.lit(size).alias("length"), F.lit(new).alias("replacement"))
    return F.array(edit(n / 4, 0, " [revised 2024] "), edit(n / 2, 25, ""), edit(n * 3 / 4, 12, "\n\nIt's new:\t"), edit(n + 1000, 0, "  the end's near."))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents").select("doc_id", "text", usual_edits().alias("edits")))
