"""Operator 12, embedding whitening: two passes for the covariance, LAPACK for its axes, a broadcast projection.

Entries become integers, x = floor(64 * c) + 1000000, so that sums, and with them means and deviations, are exact. The first pass sums x by
dimension, the second the outer products of the centred rows, a NumPy matrix product for each block of rows; what the partitions
have found is merged by treeAggregate, so the driver gets a few matrices of dimension squared whatever the number of rows.
eigh gives the axes, which go to the tasks by broadcast: at most `components` by dimension. A third pass takes the covariance of the projected
rows, which should be the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.textkit import table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries of a block: 4 MB as doubles.
BLOCK = 1 << 19
#: Components whose eigenvalue is under this share of the largest have no variance to divide by, and are left out.
LEAST_SHARE = 1e-12
#: Past this, 64 * c is no long.
_MOST = float(1 << 62)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # an axis a column
    trace: float


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: the number of entries (-1 for null), the first entry of each, and all entries as doubles, null as nan."""
    flat = column.values.cast(pa.float64())
    entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1), offsets[:-1], entries


def _blocks(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose vector is whole, and their integers, some rows at a time."""
    size, first, entries = _lists(column)
    rows = np.flatnonzero(size == dim)
    for at in range(0, len(rows), step := max(1, BLOCK // max(dim, 1))):
        some = rows[at : at + step]
        x = np.floor(entries[first[some][:, None] + np.arange(dim)] * SCALE)
        good = (np.abs(x) < _MOST).all(axis=1)  # false for nan and infinity
        yield some[good], x[good].astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where these hold it, else as Python's integers."""
    if len(x) and max(-int(x.min()), int(x.max())) * n + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def deviations(d: np.ndarray) -> list[int | None]:
    """The exact sums of squares of rows of integers; None if a long doesn't hold one."""
    if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _gathered(vectors: DataFrame, dim: int, each: Callable[[np.ndarray], tuple], add: Callable[[tuple, tuple], tuple]) -> tuple | None:
    """each() of all blocks, added up within partitions and then by treeAggregate; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, x in _blocks(b.column(0), dim):
                if len(x):
                    part = each(x)
                    total = part if total is None else add(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def merge(a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else add(a, b)

    parts = vectors.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return parts.treeAggregate(None, merge, merge)


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _sums(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension: halves of the numbers can't overflow in a block."""
    low = (x & 0xFFFFFFFF).sum(axis=0).astype(object)
    return len(x), (x >> 32).sum(axis=0).astype(object) * (1 << 32) + low


def _doubles(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, each rounded once."""
    return (_centred(x, n, sums) / n).astype(np.float64)


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest number of entries, the larger of equally common ones; 0 without any."""
    found = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return found["dim"] if found else 0


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Mean, axes and eigenvalues of the vectors of the commonest dimension without null or non-finite entries; None if there are none.

    Repeated rows count each time. Entries of 2**56 and more, whose multiple is no long, count as non-finite."""
    only = vectors.select(F.col(column).cast("array<double>").alias("v"))
    if not (dim := dimension(only, "v")) or (first := _gathered(only, dim, _sums, _add)) is None:
        return None
    n, sums = first[0], [int(s) for s in first[1]]

    def outer(x: np.ndarray) -> tuple[np.ndarray]:
        d = _doubles(x, n, sums)
        return (d.T @ d,)

    cov = _gathered(only, dim, outer, _add)[0] / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    return Whitening(n, sums, values, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0), float(np.trace(cov)))


def projection(model: Whitening, components: int = COMPONENTS) -> np.ndarray:
    """The axes, over the standard deviation along each, of the first components that have one."""
    k = int((model.values[:components] > model.values[0] * LEAST_SHARE).sum()) if model.values[0] > 0 else 0
    return model.axes[:, :k] / np.sqrt(model.values[:k])


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors, as they are, minus the identity; 0 without components."""
    axes, n, sums = projection(model, components), model.n, model.sums

    def each(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = _doubles(x, n, sums) @ axes
        return w.T @ w, w.sum(axis=0)

    square, total = _gathered(vectors.select(F.col(column).cast("array<double>").alias("v")), len(sums), each, _add)
    mean = total / n
    return float(np.abs(square / n - np.outer(mean, mean) - np.eye(axes.shape[1])).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening | None = None, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened for each remaining row and component.

    Rows whose vector is null, empty, of another than the commonest dimension, or has null or non-finite entries are left out, and components without variance as well:
    equal vectors alone give no rows. A null or repeated id stays as it is; a deviation that no long holds is null; an empty table gives
    none; other columns may have any name."""
    model = model or fit(vectors, column)
    only = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double"
    if model is None:
        return only.sparkSession.createDataFrame([], schema)
    sent = only.sparkSession.sparkContext.broadcast(projection(model, components))
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = sent.value
        k = axes.shape[1]
        for b in batches:
            for rows, x in _blocks(b.column(1), len(sums)):
                d = _centred(x, n, sums)
                w = (d / n).astype(np.float64) @ axes
                times = np.repeat(np.arange(len(rows)), k)
                ids = b.column(0).take(pa.array(rows)).take(pa.array(times))
                far = pa.array(deviations(d), pa.int64()).take(pa.array(times))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(times), n)), far, pa.array(w.reshape(-1))], ["vec_id", "component", "n", "deviation", "whitened"])

    return only.mapInArrow(run, schema)


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """whiten() with `explained`, the component's share of the whole variance, and `identity_error`, one value for all rows."""
    model = fit(vectors)
    rows = whiten(vectors, model, components)
    if model is None:
        return rows.withColumns({"explained": F.lit(None).cast("double"), "identity_error": F.lit(None).cast("double")})
    shares = [float(v / model.trace) if model.trace else 0.0 for v in model.values[:components]]
    listed = F.array(*map(F.lit, shares))
    return rows.withColumn("explained", F.get(listed, F.col("component") - 1)).withColumn("identity_error", F.lit(identity_error(vectors, model, components)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"))
