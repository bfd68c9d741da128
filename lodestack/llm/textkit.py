"""Shared helpers of the training-data operators: Arrow text access, block iteration, shared storage and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step works on; bounds a worker's memory whatever the Arrow batch holds.
BLOCK_BYTES = 1 << 18
#: Rows, and bytes of texts, of an Arrow batch that are worked on at a time.
SLICE_ROWS = 2000
SLICE_BYTES = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a
    temporary one in local mode, in which all share one machine; on a cluster that would lose data, so it raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return context._jsc.sc().getCheckpointDir().get()


#: The folders of the tables that this process wrote and has not deleted, and those that a DataFrame of materialise() reads.
_LIVE: set[str] = set()
_FOLDER: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: What the innermost scratch() has to clear.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, light: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, computes df a single time.

    The shuffle files of the write leave the disks as it ends. release() deletes the table. A light table, of keys that a shuffle has
    dealt out, is written by an eighth of the tasks: many of its files would hold a few rows each."""
    spark = df.sparkSession
    if light:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    _LIVE.add(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDER[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _LIVE.discard(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() returned, once nothing reads them any more."""
    for t in tables:
        if path := _FOLDER.pop(t, None):
            _delete(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialised within are deleted at its end, but for those given to the function that it yields."""
    mine: list[str] = []
    kept: set[str] = set()

    def keep(t: DataFrame) -> DataFrame:
        kept.add(_FOLDER[t])
        return t

    token, well = _SCOPE.set(mine), False
    try:
        yield keep
        well = True
    finally:
        _SCOPE.reset(token)
        outer = _SCOPE.get()
        for path in mine:
            if well and path in kept:
                if outer is not None:
                    outer.append(path)
            elif path in _LIVE:
                _delete(spark, path)


def live() -> frozenset[str]:
    """The tables of materialise() that are still there."""
    return frozenset(_LIVE)


def sweep(docs: DataFrame, paths: Iterable[str]) -> None:
    """Delete those tables among `paths` that docs doesn't read."""
    paths = [p for p in paths if p in _LIVE]
    if paths:
        read = docs.inputFiles()
        for p in paths:
            if not any(p.rpartition("/")[2] in f for f in read):
                _delete(docs.sparkSession, p)


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 5 = 0; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def join_hot(left: DataFrame, right: DataFrame, key: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join left to right, which has one row per key and the number of left rows of that key in `count`.

    Keys with at least a thousandth of all `total` rows number 1000 at most, so they are broadcast; the others shuffle,
    and none of them can fill a partition. Extra columns of both sides stay; `count` goes."""
    hot = right.filter(F.col(count) * 1000 >= total).drop(count)
    cold = right.filter(F.col(count) * 1000 < total).drop(count)
    mark = f"hot_{uuid.uuid4().hex[:8]}"
    marked = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    warm = marked.filter(F.col(mark)).drop(mark)
    rest = marked.filter(F.col(mark).isNull()).select(*left.columns)
    joined = rest.join(cold, key, how)
    return warm.select(*joined.columns).unionByName(joined)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets from 0; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows with at most `limit` bytes together, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(b: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_ROWS rows and `limit` bytes of strings and binaries, one row at least."""
    size = np.full(b.num_rows, 16, np.int64)
    for column in b.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy()
    for i, j in blocks(np.concatenate([[0], np.cumsum(size)]), limit):
        for s in range(i, j, SLICE_ROWS):
            yield b.slice(s, min(SLICE_ROWS, j - s))


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow with one call per slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                out = each(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


#: Bytes of text of a page, about; a longer text is a page by itself.
PAGE_BYTES = 1 << 20


def pages(docs: DataFrame) -> DataFrame:
    """(page, z): the rows of docs, all columns, some megabytes a page, written once; z is a compressed Arrow stream.

    Where rows are judged in several steps, the steps exchange keys of page and row, and texts move by page, compressed, if at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, PAGE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["z"])

    return materialise(docs.mapInArrow(run, "z binary").select(F.monotonically_increasing_id().alias("page"), "z"), "pages")


def load_page(z: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(z).read_next_batch()


def lower_letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and À-Þ lowered; every ASCII byte that is no letter becomes a space. Bytes over 127 stay."""
    out = _LUT[data]
    # UTF-8 of À-Þ (C3 80-9E) and à-þ (C3 A0-BE) differ by 32 in the second byte; C3 97 is the multiplication sign
    if len(out) > 1:
        up = np.flatnonzero(data[:-1] == 0xC3) + 1
        if len(up):
            second = data[up]
            up = up[(second <= 0x9E) & (second != 0x97)]
            out[up] += 32
    return out


_LUT = np.full(256, 32, np.uint8)
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(m, base, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word (maximal run of letters) of `data`, which is what lower_letters gave for rows with offsets off."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_word = data != 32
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    start[edge] = is_word[edge]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:]
    last = edge[edge > 0] - 1
    end[last] = is_word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        h = mix((total[e] - total[s]) * inverse[s])
    return h, np.searchsorted(off, s, "right") - 1
