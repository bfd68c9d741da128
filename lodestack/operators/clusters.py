"""k-means over vectors in array columns: a distributed draw of seeds, Lloyd rounds, empty clusters refilled; all rows take part, and only
centroids and drawn rows reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds end once no centroid moves as far.
SHIFT = 0.001
#: Draws of seeds, and how many rows each draws on average for a cluster.
DRAWS, DRAWN = 3, 2


def kmeans(vectors: DataFrame, id: str, vector: str, k: int, rounds: int, seed: int = 42) -> DataFrame:
    """(cluster, centroid) of k clusters, or as many as there are different vectors, after Lloyd rounds that end early once no centroid moves by SHIFT.

    Seeds are drawn by squared distance (see seeds). A task sums its rows by cluster in one matrix product; clusters that lose all rows
    are put on the rows farthest from their own centroids, one each, the smallest id of equally far ones."""
    cents = train(vectors, id, vector, 1, k, rounds, seed)[0]
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)], "cluster int, centroid array<double>")


def nearest(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of smallest squared distance for each row, the lowest number of equals, and that distance."""
    near = (cents**2).sum(1)[None, :] - 2 * x @ cents.T
    at = near.argmin(1)
    return at, np.maximum(near[np.arange(len(x)), at] + (x**2).sum(1), 0.0)


def _matrix(b: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(b[vector].to_numpy()).astype(float)


def _slices(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _draws(ids: pd.Series, seed: int, draw: int, parts: int) -> np.ndarray:
    """Numbers from 0 to 1 for each slice and row that depend on nothing but the id and the draw."""
    h = pd.util.hash_array(ids.to_numpy(), categorize=False).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for m in range(parts):
            x = (h ^ np.uint64((seed * 1_000_003 + draw * 4099 + m + 1) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((x ^ (x >> np.uint64(32))) / 2.0**64)
    return np.stack(out)


def seeds(vectors: DataFrame, id: str, vector: str, parts: int, k: int, seed: int) -> list[np.ndarray]:
    """k seeds for each slice of the vectors, fewer where there are fewer different ones.

    The first is the row of smallest hash. Each draw then takes every row with a chance in proportion to its squared distance from what has been
    drawn, DRAWN * k rows on average, in one pass over all rows and slices. Drawn rows are weighted by the rows that are nearest to them, and
    of these k are chosen one after another, again by weight and squared distance."""
    first = vectors.orderBy(F.xxhash64(F.lit(seed), id), id).limit(1).select(vector).collect()
    if not first:
        return [np.zeros((0, 0))] * parts
    drawn = [c[None, :] for c in np.split(np.array(first[0][0], float), parts)]
    for draw in range(DRAWS):
        spread = _spread(vectors, vector, drawn)
        if not (spread > 0).any():
            break

        def take(batches: Iterator[pd.DataFrame], drawn=drawn, spread=spread, draw=draw) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                chance = _draws(b[id], seed, draw, parts)
                for m, x in enumerate(_slices(_matrix(b, vector), parts)):
                    if spread[m] > 0:
                        rows = x[chance[m] * spread[m] < DRAWN * k * nearest(x, drawn[m])[1]]
                        if len(rows):
                            yield pd.DataFrame({"m": np.full(len(rows), m), "x": list(rows)})

        found = vectors.select(id, vector).mapInPandas(take, "m int, x array<double>").distinct().toPandas()  # some DRAWN * k rows a slice
        drawn = [np.unique(np.concatenate([c, np.stack(own)]), axis=0) if len(own := found.loc[found["m"] == m, "x"].to_numpy()) else c for m, c in enumerate(drawn)]
    weights = _weights(vectors, vector, drawn)
    rng = np.random.default_rng(seed)
    return [_chosen(c, w, k, rng) for c, w in zip(drawn, weights, strict=True)]


def _chosen(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    out = [int(weights.argmax())]
    far = ((points - points[out[0]]) ** 2).sum(1)
    while len(out) < min(k, len(points)):
        chance = far * weights if (far * weights).sum() > 0 else far
        if chance.sum() <= 0:
            break
        out.append(int(rng.choice(len(points), p=chance / chance.sum())))
        far = np.minimum(far, ((points - points[out[-1]]) ** 2).sum(1))
    return points[out]


def _spread(vectors: DataFrame, vector: str, cents: list[np.ndarray]) -> np.ndarray:
    """The sum of the squared distances of all rows to the nearest centroid, by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(cents))
        for b in batches:
            if len(b):
                total += [nearest(x, c)[1].sum() for x, c in zip(_slices(_matrix(b, vector), len(cents)), cents, strict=True)]
        yield pd.DataFrame({"m": np.arange(len(cents)), "d": total})

    summed = vectors.select(vector).mapInPandas(run, "m int, d double").groupBy("m").agg(F.sum("d").alias("d")).toPandas()
    out = np.zeros(len(cents))
    out[summed["m"]] = summed["d"]
    return out


def _weights(vectors: DataFrame, vector: str, cents: list[np.ndarray]) -> list[np.ndarray]:
    """Rows nearest to each centroid, by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [np.zeros(len(c), np.int64) for c in cents]
        for b in batches:
            if len(b):
                for m, x in enumerate(_slices(_matrix(b, vector), len(cents))):
                    n[m] += np.bincount(nearest(x, cents[m])[0], minlength=len(cents[m]))
        for m, own in enumerate(n):
            yield pd.DataFrame({"m": m, "c": np.arange(len(own)), "n": own})

    summed = vectors.select(vector).mapInPandas(run, "m int, c int, n long").groupBy("m", "c").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(len(c)) for c in cents]
    for m, c, n in summed.itertuples(index=False):
        out[m][c] = n
    return out


def train(vectors: DataFrame, id: str, vector: str, parts: int, k: int, rounds: int, seed: int = 42) -> list[np.ndarray]:
    """Of each slice of the vectors its centroids, k at most; a job a round for all slices."""
    cents = seeds(vectors, id, vector, parts, k, seed)
    for _ in range(rounds if cents[0].size else 0):
        before, cents = cents, _step(vectors, id, vector, cents)
        if max(np.sqrt(((a - b) ** 2).sum(axis=1)).max() for a, b in zip(before, cents, strict=True)) < SHIFT:
            break
    return cents


def _step(vectors: DataFrame, id: str, vector: str, cents: list[np.ndarray]) -> list[np.ndarray]:
    """The means of the rows nearest to each centroid; centroids without any are put on the farthest rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = [np.zeros(c.shape) for c in cents], [np.zeros(len(c), np.int64) for c in cents]
        for b in batches:
            if len(b):
                for m, x in enumerate(_slices(_matrix(b, vector), len(cents))):
                    at, _ = nearest(x, cents[m])
                    np.add.at(total[m], at, x)
                    n[m] += np.bincount(at, minlength=len(cents[m]))
        for m in range(len(cents)):
            yield pd.DataFrame({"m": m, "c": np.arange(len(cents[m])), "n": n[m], "total": list(total[m])})

    each = vectors.select(vector).mapInPandas(sums, "m int, c int, n long, total array<double>").filter("n > 0")
    summed = each.select("m", "c", "n", F.posexplode("total").alias("pos", "x")).groupBy("m", "c", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    out, counts = [c.copy() for c in cents], [np.zeros(len(c), np.int64) for c in cents]
    for m, own in summed.groupby("m"):
        out[m][own["c"], own["pos"]] = own["x"] / own["n"]
        counts[m][own["c"]] = own["n"]
    if empty := {m: np.flatnonzero(n == 0) for m, n in enumerate(counts) if (n == 0).any()}:
        _refill(vectors, id, vector, cents, out, empty)
    return out


def _refill(vectors: DataFrame, id: str, vector: str, cents: list[np.ndarray], out: list[np.ndarray], empty: dict[int, np.ndarray]) -> None:
    """Put the empty clusters of a slice on the rows farthest from their own centroids: each task gives its farthest, as many as are wanted."""
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == id)

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, pd.DataFrame] = {}
        for b in batches:
            if not len(b):
                continue
            for m, x in enumerate(_slices(_matrix(b, vector), len(cents))):
                if m in empty:
                    rows = pd.DataFrame({"m": m, "d": nearest(x, cents[m])[1], "id": b[id].to_numpy(), "x": list(x)})
                    kept[m] = pd.concat([kept.get(m), rows]).sort_values(["d", "id"], ascending=[False, True]).head(len(empty[m]))
        yield from kept.values()

    found = vectors.select(id, vector).mapInPandas(far, f"m int, d double, id {kind}, x array<double>").toPandas()  # some rows a task
    for m, own in found.sort_values(["d", "id"], ascending=[False, True]).groupby("m"):
        for c, x in zip(empty[m], own["x"], strict=False):
            out[m][c] = x
