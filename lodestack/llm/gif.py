"""Operator 4, media columns in GIF: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

Between two clear codes the width of every code follows from its number alone, so a segment's codes are cut out of the bits
all at once; only the dictionary is walked code by code. The bits are packed in the same way.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.textkit import arrow_map, materialise, table

WIDTH = 192
#: Rows of a frame that write() fills before it starts the next one.
ROWS = 64
BINS = 16
MAX_CODES = 4096


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a minimum code size."""
    highest = np.arange(n) + (1 << least) + 1  # of the codes that can stand here
    return np.clip(np.floor(np.log2(np.maximum(highest, 1))).astype(np.int64) + 1, least + 1, 12)


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    clear = 1 << least
    runs: list[list[int]] = []
    codes = [clear]
    if data:
        found: dict[int, int] = {}
        get, free, w = found.get, clear + 2, data[0]
        for c in data[1:]:
            k = w << 8 | c
            v = get(k)
            if v is not None:
                w = v
                continue
            codes.append(w)
            w = c
            if free < MAX_CODES:
                found[k] = free
                free += 1
            else:
                codes.append(clear)
                runs.append(codes)
                codes, found, free = [], {}, clear + 2
                get = found.get
        codes.append(w)
    codes.append(clear + 1)
    runs.append(codes)
    # the first run opens with a clear code of the starting width, after which counting begins
    widths = np.concatenate([np.concatenate([[least + 1], _widths(len(r) - 1, least)]) if k == 0 else _widths(len(r), least) for k, r in enumerate(runs)])
    flat = np.array([c for r in runs for c in r], np.uint16)
    bits = ((flat[:, None] >> np.arange(12, dtype=np.uint16)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


_SCHEDULE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lzw_decode(stream: bytes, least: int) -> bytes:
    """The samples of a code stream; ends at the end code or, if there is none, at the last whole code. Raises ValueError on a code
    that can't stand where it does."""
    clear = 1 << least
    if least not in _SCHEDULE:
        w = _widths(MAX_CODES, least)
        _SCHEDULE[least] = w, np.concatenate([[0], np.cumsum(w)])
    widths, offsets = _SCHEDULE[least]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    n_bits, at = len(stream) * 8, 0
    out: list[bytes] = []
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    words, prev = list(base), b""
    number = 0  # of the next code since the last clear code
    while at < n_bits:
        if number < MAX_CODES:
            w, start = widths[number:], offsets[number:-1] - offsets[number] + at
        else:  # the table is full, the width stays
            w = np.full(MAX_CODES, 12)
            start = at + 12 * np.arange(MAX_CODES)
        fits = start + w <= n_bits
        w, start = w[fits], start[fits]
        if not len(w):
            break
        byte = start >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(marks[0]) if len(marks) else len(codes)
        for c in codes[:stop].tolist():
            if c < len(words):
                word = words[c]
            elif prev and c == len(words):
                word = prev + prev[:1]
            else:
                raise ValueError(f"code {c} with {len(words)} codes known")
            if prev and len(words) < MAX_CODES:
                words.append(prev + word[:1])
            out.append(word)
            prev = word
        number += stop
        if len(marks):
            if codes[stop] == clear + 1:
                break
            at = int(start[stop] + w[stop])
            words, prev, number = list(base), b"", 0
        else:
            at = int(start[-1] + w[-1])
    return b"".join(out)


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    index: np.ndarray  # stored samples, rows by columns
    rgb: np.ndarray  # the whole canvas as it shows, rows by columns by 3


#: Pixels of a canvas, and of all frames of a medium, beyond which it isn't read.
MOST_PIXELS = 1 << 24


def read(data: bytes) -> list[Frame]:
    """The frames of a GIF as stored and as shown. Disposal 2 clears a frame's area to black, disposal 3 restores what was there.

    Raises ValueError for what is no GIF, breaks off, or is larger than MOST_PIXELS on its canvas or times its frames."""
    try:
        return _frames(data)
    except IndexError:
        raise ValueError("the file breaks off") from None


def _frames(data: bytes) -> list[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    left_over = 64 * MOST_PIXELS // max(1, width * height)  # frames that may follow
    flags, at = data[10], 13

    def palette(flag: int) -> np.ndarray | None:
        nonlocal at
        if not flag & 0x80:
            return None
        n = 3 << (flag & 7) + 1
        if at + n > len(data):
            raise ValueError("the file breaks off")
        colours = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
        return colours

    def joined() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
            if at > len(data):
                raise ValueError("the file breaks off")
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    frames: list[Frame] = []
    delay = disposal = 0
    transparent: int | None = None
    while data[at] != 0x3B:
        kind = data[at]
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = joined()
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x}")
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (0, 2, 4, 6))
        flag = data[at + 8]
        at += 9
        if w * h > MOST_PIXELS or len(frames) >= left_over:
            raise ValueError(f"frame {len(frames)} of {w} x {h} is too much")
        colours = palette(flag)
        colours = shared if colours is None else colours
        least = data[at]
        at += 1
        if not 1 <= least <= 8:
            raise ValueError(f"codes of {least} bits")
        samples = np.frombuffer(lzw_decode(joined(), least)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flag & 0x40:  # interlaced: four passes over the rows
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        shown = colours[np.minimum(seen, len(colours) - 1)] if colours is not None else np.repeat(seen[:, :, None], 3, 2)
        area[:] = shown if transparent is None else np.where((seen == transparent)[:, :, None], area, shown)
        frames.append(Frame(delay, disposal, transparent, left, top, samples, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay = disposal = 0
        transparent = None
    return frames


_N = np.arange(256)
#: The palette of a payload: samples as they are, spread, and reversed, so that the channels tell different things.
_COLOURS = np.stack([_N, _N * 7 % 256, 255 - _N], axis=1).astype(np.uint8).tobytes()


def write(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """Whole rows of 8-bit samples as an animation of frames of up to `rows` rows each, in the colours of one palette."""
    n = len(samples) // width
    parts = [b"GIF89a", width.to_bytes(2, "little"), min(n, rows).to_bytes(2, "little"), b"\xf7\0\0", _COLOURS]
    for top in range(0, n, rows):
        part = samples[top * width : (top + rows) * width]
        parts.append(b"\x21\xf9\x04\x04" + (delay_ms // 10).to_bytes(2, "little") + b"\0\0\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08")
        stream = lzw_encode(part)
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    parts.append(b";")
    return b"".join(parts)


def histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Pixels of the frame's area as shown, by channel and bin."""
    h, w = frame.index.shape
    area = frame.rgb[frame.top : frame.top + h, frame.left : frame.left + w]
    return np.stack([np.bincount((area[:, :, c].ravel().astype(np.int64) * bins) >> 8, minlength=bins) for c in range(3)])


_FRAME = "doc_id long, frame int, delay_ms int, disposal int, left int, top int, width int, height int, red array<long>, green array<long>, blue array<long>, error string"


def frames_column(media: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id, frame, delay_ms, disposal, left, top, width, height, red, green, blue (histograms), error: the frames of media(doc_id, media).

    A null or empty medium has none. One that can't be read, for it is no GIF, breaks off or is too large, has a row of nulls with the
    error. Repeated rows give repeated frames, an empty table none; only doc_id and media are read, so other columns may have any name."""
    names = [f.split()[0] for f in _FRAME.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 7, *[pa.list_(pa.int64())] * 3, pa.string()]

    def each(b: pa.RecordBatch):
        for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
            if not data:
                continue
            try:
                rows = [(doc, k, f.delay_ms, f.disposal, f.left, f.top, f.index.shape[1], f.index.shape[0], *histogram(f, bins).tolist(), None) for k, f in enumerate(read(data))]
            except ValueError as e:
                rows = [(doc, *[None] * 10, str(e))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arrow_map(media.select("doc_id", "media"), each, _FRAME)


def payload(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" "), len(raw)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a GIF) for every row of docs(doc_id, text)."""

    def each(b: pa.RecordBatch):
        texts = b.column("text").to_pylist()
        for s in range(0, len(texts), 200):
            both = [payload(t) for t in texts[s : s + 200]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s, 200), pa.array([x[1] for x in both], pa.int64()), pa.array([write(x[0]) for x in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, n_bytes long, media binary")


_TRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, duration_ms for every row
    of docs(doc_id, text).

    The media are written as a table and read back from it. The payload is what their frames hold, the feature the histogram of each
    channel as shown, over all frames. A null or empty text is a payload of one row of spaces. Equal texts have equal results; an
    empty table gives no rows; only doc_id and text are read, so other columns may have any name."""
    names = [f.split()[0] for f in _TRIP.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for n, media in zip(b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
            frames = read(media)
            back = b"".join(f.index.tobytes() for f in frames)
            colours = sum(histogram(f) for f in frames)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, colours.ravel().tolist())), len(frames), sum(f.delay_ms for f in frames)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    stored = materialise(media_column(docs), "media")
    return arrow_map(stored, each, _TRIP)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
