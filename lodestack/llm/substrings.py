"""Operator 10, exact substring dedup by a depth-limited radix sort of suffixes.

A suffix needs ordering only through its first `length` bytes: suffixes that agree so far are the repeated windows. They are
sorted most significant digit first, eight bytes a pass, and a suffix leaves the sort once its group has a single member.

Not all suffixes of the corpus have to meet for that. Each window of `length` bytes is given an anchor, the q-gram of smallest
hash in it (the leftmost of equals), which depends on the window's bytes alone; so equal windows have equal anchors, at equal
distances. Texts are stored in pages of some megabytes. A first pass finds the anchors that occur in two or more pages, a second
one sends only the windows of those and of the anchors that a page has in two documents, as snippets that cover all windows of one
occurrence, to the task that sorts the anchor's windows. Hashes choose what meets; equality is always decided on the bytes.

A task gathers the snippets of some pages and sends each once, for the document of smallest id that has it; for its others the answer
is known. So neither copies of whole texts nor a line that is in every document fill a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.textkit import arrow_map, blocks, load_page, materialise, mix, pages, release, table, utf8

LENGTH = 50
Q = 20
NONE = (1 << 63) - 1


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Occurrences of anchors in rows of bytes: (row, position, hash, first window, last window), positions in `data`.

    Each window of `length` bytes that lies in one row belongs to exactly one occurrence."""
    n, w = len(data), length - q + 1
    windows = n - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        h, have = mix(data.astype(np.uint64) + np.uint64(0x51ED270B)), 1
        while have < q:  # the hash of 2k bytes from those of k, and a last step that overlaps
            step = min(have, q - have)
            m = len(h) - step
            h = mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            have += step
    # hash above, position below: the smallest is the leftmost of the q-grams with the smallest hash
    low = np.uint64(24)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < w:
        step = min(have, w - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    inside = np.flatnonzero(np.arange(windows) + length <= off[1:][row])
    key, row = key[inside], row[inside]
    if not len(key):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    # a new occurrence where the anchor, or the row, changes
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    position = (key[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    del low
    return row[at], position, h[position], inside[at], inside[last]


#: Bytes of one vectorised step; positions must fit in 24 bits.
_STEP = 1 << 18
_PIECE = 1 << 23


def _anchored(data: np.ndarray, off: np.ndarray, length: int, q: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() by blocks of rows; positions and rows count from the start of data. Rows of more than _PIECE bytes are cut into
    pieces that overlap in length - 1 bytes, so that each window lies in one."""
    for i, j in blocks(off, _STEP):
        size = int(off[j] - off[i])
        if size <= _PIECE:
            row, pos, h, first, last = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i], length, q)
            yield row + i, pos + off[i], h, first + off[i], last + off[i]
        else:
            for a in range(0, size - length + 1, _PIECE - length + 1):
                part = data[off[i] + a : min(off[i] + a + _PIECE, off[j])]
                row, pos, h, first, last = anchors(part, np.array([0, len(part)]), length, q)
                yield row + i, pos + off[i] + a, h, first + off[i] + a, last + off[i] + a


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def radix_groups(text: np.ndarray, at: np.ndarray, length: int, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, group) of those suffixes text[at:] that agree with another one in `length` bytes, ordered by group.

    Most significant digits first: a pass orders by the next eight bytes within the groups of the last, and drops what is alone.
    `seed` may split the suffixes beforehand into classes that can't agree."""
    alive, group = np.arange(len(at)), np.zeros(len(at), np.int64) if seed is None else np.unique(seed, return_inverse=True)[1]
    for depth in [None, *range(0, length, 8)]:
        if depth is None:
            if seed is None:
                continue
            order = np.argsort(group, kind="stable")
            alive, group = alive[order], group[order]
            differs = group[1:] != group[:-1]
        else:
            digit = np.zeros(len(alive), np.uint64)
            start = at[alive] + depth
            for k in range(8):
                digit <<= np.uint64(8)
                if depth + k < length:
                    digit |= text[start + k].astype(np.uint64)
            order = np.lexsort((digit, group))
            alive, group, digit = alive[order], group[order], digit[order]
            differs = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        first = np.concatenate([[True], differs])
        single = first & np.append(first[1:], True)
        group = np.cumsum(first) - 1
        alive, group = alive[~single], group[~single]
        if not len(alive):
            break
    return alive, group


_LEVEL = 3
#: What is sent of the snippets of some pages and a bucket, a column each, bytes of equal weight together: that compresses best.
_PARTS = {"hashes": "<u8", "ranks": "<i8", "lead": "u1", "sizes": "<u2", "bytes": "u1", "owners": "<u4", "pages": "<i8", "rows": "<u4", "starts": "<i8"}
#: Anchors, and a quarter of the bytes of snippets, that a task gathers over its pages before it sends them.
_FLUSH = 1 << 20


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _expanded(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _occurrences(data: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(row, position, hash, first window, last window) of all anchors of a page."""
    found = list(zip(*_anchored(data, off, length, q), strict=True))
    return tuple(map(np.concatenate, found)) if found else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first[k] to first[k] + size[k] - 1 of all k, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[k] bytes from a[k] and from b[k] differ, for all k."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        part = slice(at, stop)
        unlike = data[_ranges(a[part], size[part])] != data[_ranges(b[part], size[part])]
        out[part] = np.add.reduceat(unlike, np.cumsum(size[part]) - size[part]) > 0
        at = stop
    return out


def _combined(data: np.ndarray, ranks: np.ndarray, h: np.ndarray, first: np.ndarray, lead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal snippets: (the one of least rank of each kind, for every snippet the number of its kind, and whether its rank is larger
    than the least). Keys choose what is compared; equality is decided on the bytes."""
    with np.errstate(over="ignore"):
        key = mix(h + mix((lead * 65_599 + size).astype(np.uint64)))
    order = np.lexsort((ranks, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order  # of each place in the order
    other = np.flatnonzero(~new)
    same = (size[order[other]] == size[head[other]]) & (lead[order[other]] == lead[head[other]]) & (h[order[other]] == h[head[other]])
    pair = other[same]
    same[same] = ~_differ(data, first[order[pair]], first[head[pair]], size[order[pair]])
    alone = new.copy()
    alone[other[~same]] = True  # its key is that of another snippet
    heads = order[alone]
    number = np.zeros(len(order), np.int64)
    at = np.cumsum(alone) - 1
    at[other[same]] = (np.cumsum(alone) - 1)[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[other[same]]]
    number[order] = at
    return heads, number, ranks > ranks[heads][number]


def _home(page: np.ndarray, n: int) -> np.ndarray:
    return _bucket(mix(page.astype(np.uint64)), n)


def repeated_spans(stored: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(page, spans): for those of pages() that have any, the maximal runs of bytes covered by a window of `length` bytes that also
    starts in a document of smaller rank, as squeezed triples of longs (row of the page, start, end) in order.

    Rank is doc_id, a null one after all others; rows of equal rank don't count for each other. What tasks exchange are packed blocks,
    one for each bucket of some pages at most. Of equal snippets in these pages one is sent, for the least of their ranks; the others
    are known to be repeats at once. So a passage that is everywhere costs a snippet in some megabytes, not one a document."""
    shuffles = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(z: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        b = load_page(z)
        data, off = utf8(b.column("text"))
        ranks = pc.fill_null(b.column("doc_id").cast(pa.int64()), NONE).to_numpy()
        return data, off, ranks, _occurrences(data, off, length, q)

    def by_bucket(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes by bucket, and where each bucket begins."""
        own = np.unique(h)
        buckets = _bucket(own, shuffles)
        order = np.argsort(buckets, kind="stable")
        return own, order, np.searchsorted(buckets[order], np.arange(shuffles + 1))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of some pages by bucket: for each page six bytes of the hash of each."""
        kept: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(h) for _, h, _ in kept]
            which = np.repeat(np.arange(len(kept)), sizes)
            buckets = np.concatenate([k for _, _, k in kept])
            order = np.argsort(buckets, kind="stable")  # pages and hashes stay in order within a bucket
            short = (np.concatenate([h for _, h, _ in kept])[order] // np.uint64(shuffles)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            buckets, which = buckets[order], which[order]
            used = np.unique(buckets)
            cuts = np.append(np.searchsorted(buckets, used), len(buckets))
            ids = np.array([page for page, _, _ in kept], "<i8")
            out: dict[str, list[bytes]] = {"pages": [], "sizes": [], "hashes": []}
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own, counts = np.unique(which[i:j], return_counts=True)
                out["pages"].append(_squeezed(ids[own]))
                out["sizes"].append(_squeezed(counts.astype("<i8")))
                out["hashes"].append(zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(short[i:j].T).tobytes()))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(out[k], pa.binary()) for k in out)], ["bucket", *out])

        for b in batches:
            for page, z in zip(b.column("page").to_pylist(), b.column("z").to_pylist(), strict=True):
                own, order, _ = by_bucket(read(z)[3][2])
                kept.append((page, own[order], _bucket(own[order], shuffles)))
                if sum(len(h) for _, h, _ in kept) >= _FLUSH:
                    yield flush()
        if kept:
            yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A flag for each anchor of the partition: whether another page has it. Blocks are addressed to the homes of pages."""
        expand = zstandard.ZstdDecompressor().decompress
        bucket, page, sizes, hashes = [], [], [], []
        for b in batches:
            for k, p, n, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "pages", "sizes", "hashes")), strict=True):
                part = np.frombuffer(expand(blob), np.uint8).reshape(6, -1)
                raw = np.zeros((part.shape[1], 8), np.uint8)
                raw[:, :6] = part.T
                page.append(_expanded(p, "<i8"))
                sizes.append(_expanded(n, "<i8"))
                bucket.append(np.full(len(page[-1]), k))
                hashes.append((raw.view("<u8").ravel() << np.uint64(12)) | np.uint64(k % 4096))
        if not page:
            return
        bucket, page, sizes = map(np.concatenate, (bucket, page, sizes))
        h = np.concatenate(hashes)
        hashes.clear()
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        flags = np.zeros(len(h), np.uint8)
        flags[order] = np.concatenate([[False], same]) | np.append(same, False)
        stops = np.cumsum(sizes)
        home = _home(page, shuffles)
        out = {"home": [], "pages": [], "buckets": [], "sizes": [], "flags": []}
        for to in np.unique(home).tolist():
            own = np.flatnonzero(home == to)
            out["home"].append(to)
            out["pages"].append(_squeezed(page[own]))
            out["buckets"].append(_squeezed(bucket[own].astype("<i4")))
            out["sizes"].append(_squeezed(sizes[own]))
            out["flags"].append(_squeezed(flags[_ranges(stops[own] - sizes[own], sizes[own])]))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "home" else pa.binary()) for k, v in out.items()})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The flags of each page, by bucket and hash."""
        got: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            for p, k, n, f in zip(*(b.column(c).to_pylist() for c in ("pages", "buckets", "sizes", "flags")), strict=True):
                flags, at = _expanded(f, "u1"), 0
                for page, bucket, size in zip(_expanded(p, "<i8").tolist(), _expanded(k, "<i4").tolist(), _expanded(n, "<i8").tolist(), strict=True):
                    got.setdefault(page, []).append((bucket, flags[at : at + size]))
                    at += size
        for page, parts in got.items():
            parts.sort(key=lambda x: x[0])
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([_squeezed(np.concatenate([x[1] for x in parts]))], pa.binary())], ["page", "flags"])

    offered = stored.mapInArrow(offer, "bucket int, pages binary, sizes binary, hashes binary")
    answers = offered.repartitionById(shuffles, F.col("bucket")).mapInArrow(shared, "home int, " + ", ".join(f"{k} binary" for k in ("pages", "buckets", "sizes", "flags")))
    found = materialise(answers.repartitionById(shuffles, F.col("home")).mapInArrow(told, "page long, flags binary"), "anchors", light=True)
    kinds = {"bucket": pa.int32(), **{k: pa.binary() for k in (*_PARTS, "spans")}}

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each snippet around an anchor that has company its bytes, by bucket; and the spans that are known without the others."""
        kept: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, ranks, lead, size, text, page, row, start = map(np.concatenate, zip(*kept, strict=True))
            kept.clear()
            first = np.cumsum(size) - size
            heads, number, later = _combined(text, ranks, h, first, lead, size)
            out: dict[str, list] = {k: [] for k in kinds}
            if later.any():
                ids, at = np.unique(page, return_inverse=True)
                own, a, e = _union((at[later] << 32) | row[later], start[later], (start + size)[later])
                known = np.stack([ids[own >> 32], own & 0xFFFFFFFF, a, e], axis=1)
                home = _home(known[:, 0], shuffles)
                for to in np.unique(home).tolist():
                    out["bucket"].append(to)
                    out["spans"].append(_squeezed(known[home == to].astype("<i8").ravel()))
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(number[mine], kind="stable")]  # owners by snippet
            owners = np.bincount(number[mine], minlength=len(heads))
            begins = np.cumsum(owners) - owners
            buckets = _bucket(h[heads], shuffles)
            by = np.argsort(buckets, kind="stable")
            used = np.unique(buckets)
            cuts = np.append(np.searchsorted(buckets[by], used), len(by))
            for k, i, j in zip(used.tolist(), cuts[:-1], cuts[1:], strict=True):
                s = by[i:j]
                o, x = heads[s], mine[_ranges(begins[s], owners[s])]
                part = {"hashes": h[o], "ranks": ranks[o], "lead": lead[o], "sizes": size[o], "bytes": text[_ranges(first[o], size[o])], "owners": owners[s], "pages": page[x], "rows": row[x], "starts": start[x]}
                out["bucket"].append(k)
                out["spans"].append(None)
                for name, kind in _PARTS.items():
                    out[name].append(_squeezed(part[name].astype(kind)))
            for name in _PARTS:
                out[name] = [None] * (len(out["bucket"]) - len(out[name])) + out[name]
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

        held = 0
        for b in batches:
            for page, z, known in zip(*(b.column(c).to_pylist() for c in ("page", "z", "flags")), strict=True):
                data, off, ranks, (row, pos, h, first, last) = read(z)
                own, order, _ = by_bucket(h)
                wanted = np.zeros(len(own), bool)
                wanted[order] = _expanded(known, "u1") > 0
                which = np.searchsorted(own, h)
                least, most = np.full(len(own), len(off)), np.full(len(own), -1)
                np.minimum.at(least, which, row)
                np.maximum.at(most, which, row)
                c = np.flatnonzero((wanted | (least < most))[which])
                if not len(c):
                    continue
                row, pos, h, first, last = (x[c] for x in (row, pos, h, first, last))
                size = last - first + length
                kept.append((h, ranks[row], pos - first, size, data[_ranges(first, size)], np.full(len(row), page), row, first - off[row]))
                held += len(kept[-1][4])
                if held >= 4 * _FLUSH:
                    held = 0
                    yield flush()
        if kept:
            yield flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans of the partition's snippets, a block for each home of pages."""
        parts: dict[str, list[np.ndarray]] = {k: [] for k in _PARTS}
        spans = []
        for b in batches:
            for k in range(b.num_rows):
                if (ready := b.column("spans")[k].as_py()) is not None:
                    spans.append(_expanded(ready, "<i8").reshape(-1, 4))
                    continue
                for name, kind in _PARTS.items():
                    parts[name].append(_expanded(b.column(name)[k].as_py(), kind))
        if parts["hashes"]:
            p = {k: np.concatenate(v) for k, v in parts.items()}
            parts.clear()
            s, a, e = _later(p, length)
            owners = p["owners"].astype(np.int64)
            x = _ranges((np.cumsum(owners) - owners)[s], owners[s])
            who = np.repeat(np.arange(len(s)), owners[s])
            spans.append(np.stack([p["pages"][x], p["rows"][x].astype(np.int64), p["starts"][x] + a[who], p["starts"][x] + e[who]], axis=1))
        if not sum(map(len, spans)):
            return
        both = np.concatenate(spans)
        home = _home(both[:, 0], shuffles)
        order = np.argsort(home, kind="stable")
        both, home = both[order], home[order]
        to = np.unique(home)
        cuts = np.searchsorted(home, np.append(to, shuffles))
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([_squeezed(both[i:j].astype("<i8").ravel()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["home", "spans"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_expanded(x, "<i8").reshape(-1, 4) for b in batches for x in b.column("spans").to_pylist()]
        if not got:
            return
        both = np.concatenate(got)
        page, at = np.unique(both[:, 0], return_inverse=True)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(page) + 1))
        for k, one in enumerate(page.tolist()):
            mine = both[order[cuts[k] : cuts[k + 1]]]
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([_squeezed(np.stack(_union(mine[:, 1], mine[:, 2], mine[:, 3]), axis=1).astype("<i8").ravel())], pa.binary())], ["page", "spans"])

    candidates = stored.join(found.hint("shuffle_hash"), "page")
    sent = candidates.select("page", "z", "flags").mapInArrow(snippets, "bucket int, " + ", ".join(f"{k} binary" for k in (*_PARTS, "spans")))
    sorted_ = sent.repartitionById(shuffles, F.col("bucket")).mapInArrow(sort, "home int, spans binary")
    spans = materialise(sorted_.repartitionById(shuffles, F.col("home")).mapInArrow(merge, "page long, spans binary"), "spans", light=True)
    release(found)
    return spans


def _later(p: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, start, end): the runs of each snippet that windows cover which a snippet of smaller rank has, too.

    Of equal snippets those of a larger rank are covered whole, and one of the least rank is compared with others for all of these."""
    size = p["sizes"].astype(np.int64)
    total = np.cumsum(size) - size
    heads, number, later = _combined(p["bytes"], p["ranks"], p["hashes"], total, p["lead"].astype(np.int64), size)
    order = heads[np.argsort(p["hashes"][heads], kind="stable")]
    new = np.concatenate([[True], p["hashes"][order][1:] != p["hashes"][order][:-1]])
    single = new & np.append(new[1:], True)  # nothing else has its anchor
    order, new = order[~single], new[~single]
    marks = np.flatnonzero(new)
    # whole anchors at a time, in runs of about two million windows
    counts = np.cumsum(size[order] - length + 1)
    edges = [0]
    for m in [*marks[1:].tolist(), len(order)]:
        if m and (counts[m - 1] - (counts[edges[-1] - 1] if edges[-1] else 0) > 2_000_000 or m == len(order)):
            edges.append(m)
    hits, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, e in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:e]
        windows = size[own] - length + 1
        snippet = np.repeat(own, windows)
        rel = _ranges(np.zeros(len(own), np.int64), windows)
        # equal windows have their anchor at the same distance from their start
        distance = p["lead"][snippet].astype(np.int64) - rel
        with np.errstate(over="ignore"):
            seed = mix(p["hashes"][snippet] + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        alive, group = radix_groups(p["bytes"], total[snippet] + rel, length, seed)
        if not len(alive):
            continue
        rank = p["ranks"][snippet[alive]]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(group))))
        hit = alive[rank > least]
        hits.append(snippet[hit])
        at.append(rel[hit])
    s, r = np.concatenate(hits), np.concatenate(at)
    s, a, e = _union(s, r, r + length)
    # what holds for one of the least rank holds for its equals of that rank
    equal = np.flatnonzero(~later)
    equal = equal[np.argsort(number[equal], kind="stable")]
    members = np.bincount(number[equal], minlength=len(heads))
    kind = number[s]
    who = equal[_ranges((np.cumsum(members) - members)[kind], members[kind])]
    whole = np.flatnonzero(later)
    return np.concatenate([who, whole]), np.concatenate([np.repeat(a, members[kind]), np.zeros(len(whole), np.int64)]), np.concatenate([np.repeat(e, members[kind]), size[whole]])


def _union(own: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end): for each owner the union of its ranges as maximal runs, in order."""
    if not len(own):
        return own, start, end
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], end[order]
    group = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
    # ranges of one owner reach neither the next one's nor one that lies beyond their running maximum
    far = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])]))
    return own[new], start[new], reach[np.append(new[1:], len(own)) - 1]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans, which are in order and apart."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def _spans_of(blob: bytes | None, n: int) -> list[list[tuple[int, int]]]:
    """The spans of each of the n rows of a page."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for row, a, b in _expanded(blob, "<i8").reshape(-1, 3).tolist() if blob else ():
        out[row].append((a, b))
    return out


def dedup_report(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text).

    A null or empty text has no bytes. A row with a null id comes after all others and never makes another one lose bytes; rows of
    one id don't count for each other. An empty table gives no rows; only doc_id and text are read, so other columns may have any
    name. Overlapping windows count once; all are judged on the input."""
    stored = pages(docs.select("doc_id", "text"))
    spans = repeated_spans(stored, length, q)

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for z, blob in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            page = load_page(z)
            texts = [(t or "").encode() for t in page.column("text").to_pylist()]
            cuts = _spans_of(blob, len(texts))
            shas = [hashlib.sha256(cut(t, s)).hexdigest() for t, s in zip(texts, cuts, strict=True)]
            longs = [list(map(len, texts)), [sum(y - x for x, y in s) for s in cuts], list(map(len, cuts))]
            yield pa.RecordBatch.from_arrays([page.column("doc_id"), *(pa.array(x, pa.int64()) for x in longs), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(stored.join(spans.hint("shuffle_hash"), "page", "left").select("z", "spans"), each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """docs, all rows and columns, with the repeated bytes taken out of text; n_chars, if there, is counted anew.

    Bytes left of a character that was cut in two are dropped. Null texts stay null; otherwise as dedup_report."""
    stored = pages(docs)
    spans = repeated_spans(stored, length, q)
    at = docs.columns.index("text")

    def each(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for z, blob in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            page = load_page(z)
            texts = page.column(at).to_pylist()
            columns = list(page.columns)
            columns[at] = pa.array([cut(t.encode(), s).decode(errors="ignore") if s else t for t, s in zip(texts, _spans_of(blob, len(texts)), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=page.schema)

    done = arrow_map(stored.join(spans.hint("shuffle_hash"), "page", "left").select("z", "spans"), each, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))
