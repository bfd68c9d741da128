"""Operator 2, byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

Within a pre-token every adjacent pair whose bytes form a token waits in the bucket of its rank. A bitmap of ranks, with a
summary bitmap above it, finds the lowest rank that waits by find-first-set; its leftmost position is merged, which may queue
the pairs on either side anew. Entries that no longer hold are skipped when they come up. Each merge costs the same however
long the pre-token is, so a pre-token of n bytes takes n queue steps, not n scans.

Pre-tokens repeat, so workers keep the ids of short ones that they have seen, in two generations of bounded bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush
from struct import pack
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.textkit import arrow_map, table

RANKS = "byte_bpe_50k.tiktoken"

#: Patterns as tiktoken reads them: its white space is the Unicode property.
_ANY = regex.compile(public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
#: The same over texts of ASCII and Latin letters alone, for the faster engine.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ɏ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_BEYOND_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
#: A space that does not simply lead the next word.
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")


def pre_tokens(text: str) -> list[str]:
    return (_ANY if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


def load_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the token that starts at a byte
    waits = [get(piece[i : i + 2], -1) for i in range(n - 1)]
    waits.append(-1)
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    summary = 0
    for i, rank in enumerate(waits):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)  # positions ascend, which is a heap already
            else:
                buckets[rank] = [i]
                leaf = rank >> 8
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & 255)
                summary |= 1 << leaf
    while summary:
        top = summary & -summary
        leaf = top.bit_length() - 1
        bits = leaves[leaf]
        low = bits & -bits
        rank = leaf << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) == 1:
            i = bucket[0]
            del buckets[rank]
            if bits == low:
                summary ^= top
                leaves[leaf] = 0
            else:
                leaves[leaf] = bits ^ low
        else:
            i = heappop(bucket)
        if waits[i] != rank:
            continue
        j = end[i]
        k = end[i] = end[j]
        waits[j] = -1
        # the pairs that the new token is part of: with what comes before it, and with what follows
        if (at := before[i]) >= 0:
            fresh = waits[at] = get(piece[at:k], -1)
            if fresh >= 0:
                if fresh in buckets:
                    heappush(buckets[fresh], at)
                else:
                    buckets[fresh] = [at]
                    leaf = fresh >> 8
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (fresh & 255)
                    summary |= 1 << leaf
        if k < n:
            before[k] = i
            fresh = waits[i] = get(piece[i : end[k]], -1)
            if fresh >= 0:
                if fresh in buckets:
                    heappush(buckets[fresh], i)
                else:
                    buckets[fresh] = [i]
                    leaf = fresh >> 8
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (fresh & 255)
                    summary |= 1 << leaf
        else:
            waits[i] = -1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memo(dict):
    """What is kept of keys, and before that: memos of one pool share its `size` bytes by what is asked of them, and start anew together."""

    def __init__(self, size: int, pool: list[Memo]):
        super().__init__()
        self.size, self.used, self.old, self.pool = size, 0, {}, pool
        pool.append(self)

    def keep(self, key: str, value):
        """A key of over LONGEST characters is not kept: it hardly comes again, and a text without spaces is a single one."""
        if len(key) <= LONGEST:
            cost = getsizeof(key) + getsizeof(value) + _ENTRY
            if sum([m.used for m in self.pool]) + cost > self.size:
                for m in self.pool:
                    m.old, m.used = dict(m), 0
                    m.clear()
            self.used += cost
            self[key] = value
        return value


LONGEST = 64
_ENTRY = 100  # bytes of a dictionary's slot, about


class Encoder:
    """Texts to ids as bytes of little-endian unsigned 32-bit numbers; `memo` bounds the bytes of each of two generations."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 100 << 20):
        self.ranks = ranks
        pool: list[Memo] = []
        self.words, self.led, self.first, self.sizes = (Memo(memo, pool) for _ in range(4))

    def _ids(self, piece: str) -> bytes:
        if known := self.words.old.get(piece) or (piece[0] == " " and self.led.old.get(piece[1:])):
            return known
        ids = merge(piece.encode(), self.ranks)
        return pack(f"<{len(ids)}I", *ids)

    def word(self, piece: str) -> bytes:
        """A pre-token that leads with a space is often known as what lies between spaces, where it is cut the same way."""
        return self.words.get(piece) or (piece[0] == " " and self.led.get(piece[1:])) or self.words.keep(piece, self._ids(piece))

    def size(self, piece: str) -> int:
        """Tokens of a pre-token."""
        got = self.sizes.get(piece)
        return got or self.sizes.keep(piece, self.sizes.old.get(piece) or len(merge(piece.encode(), self.ranks)))

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        got = list(map(self.sizes.get, pieces))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.size(pieces[k])
        return got

    def chunk(self, text: str) -> bytes:
        """What is one pre-token is kept by the caller, under its own key, and not twice."""
        pieces = pre_tokens(text)
        return b"".join(map(self.word, pieces)) if len(pieces) > 1 else b"".join(self.words.get(p) or self._ids(p) for p in pieces)

    def encode(self, text: str) -> bytes:
        """A pre-token never reaches over a space that leads a word, so what lies between such spaces is looked up as a whole."""
        if len(text) > 1 << 16 or _LOOSE_SPACE.search(text):
            return self.chunk(text)
        head, *rest = text.split(" ")
        start = (self.first.get(head) or self.first.old.get(head) or self.first.keep(head, self.chunk(head))) if head else b""
        got = list(map(self.led.get, rest))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    c = rest[k]
                    got[k] = self.led.get(c) or self.led.keep(c, self.led.old.get(c) or self.chunk(" " + c))
        return start + b"".join(got)


_STATE: dict[str, tuple[Encoder, list[str], list[bytes]]] = {}


def _state(name: str) -> tuple[Encoder, list[str], list[bytes]]:
    """The worker's encoder, the decimal form of each id and the bytes of each id."""
    if name not in _STATE:
        ranks = load_ranks(name)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        _STATE[name] = (Encoder(ranks), list(map(str, range(len(tokens)))), tokens)
    return _STATE[name]


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def encode_column(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, ids array<int> for every row of docs(doc_id, text); a null text has no ids."""

    def each(b: pa.RecordBatch):
        encoder = _state(name)[0]
        texts = b.column("text").to_pylist()
        for s in range(0, len(texts), 500):
            ids = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(np.int32) for t in texts[s : s + 500]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, 500), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, ids array<int>")


def decode_column(ids: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, bytes binary for every row of ids(doc_id, ids)."""

    def each(b: pa.RecordBatch):
        tokens = _state(name)[2]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decode(x or [], tokens) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return arrow_map(ids.select("doc_id", "ids"), each, "doc_id long, bytes binary")


def digests(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs(doc_id, text).

    A null text counts as empty: no tokens, digests of no bytes. Repeated rows give repeated results, an empty table none; only
    doc_id and text are read, so other columns may have any name. Strings of special tokens are ordinary text."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decimal, tokens = _state(name)
        n, of_ids, of_bytes = [], [], []
        for i in range(b.num_rows):
            ids = np.frombuffer(encoder.encode(b.column("text")[i].as_py() or ""), "<u4").tolist()
            n.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(decode(ids, tokens)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
