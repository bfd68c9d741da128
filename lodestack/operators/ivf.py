"""An inverted file over residual product codes: approximate nearest vectors whose recall is measured, for any number of rows and queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.vectors import squared_l2
from lodestack.operators.clusters import nearest, train
from lodestack.operators.search import best_of_blocks

#: Slices of a vector, each coded in a byte.
PARTS, CODES, ROUNDS = 16, 256, 20
#: Rows that the cells and code books are fitted on at most, those of smallest hash; all rows are indexed.
SAMPLE = 65_536
MOST_CELLS = 65_536
#: Rows of a stored piece of a cell, and queries that meet one at a time.
PIECE, TOGETHER = 4096, 256
#: Queries by which the number of probes and candidates is measured, and the share of their neighbours that these must find.
TRIED, AIM = 64, 0.97


@dataclass
class Index:
    """Where the index lies, its cells and code books, and how much of it a query reads."""

    path: str
    cells: np.ndarray  # a centroid a row
    books: list[np.ndarray]
    probes: int = 0
    candidates: int = 0
    recall: float = 0.0  # of the queries that tune() tried


def build(vectors: DataFrame, id: str, vector: str, path: str, parts: int = PARTS, cells: int | None = None) -> Index:
    """Index all rows of vectors under path, by cell; the square root of their number of cells unless told otherwise.

    codes/ has a row for each piece of a cell, its ids and a byte for each slice of the residuals; a cell of many rows, such as equal
    ones, has many pieces. vectors/ has the rows themselves."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors.select(id, F.col(vector).cast("array<double>").alias(vector))
    sample.orderBy(F.xxhash64(F.lit(7), id), id).limit(SAMPLE).write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    centres = train(sample, id, vector, 1, min(MOST_CELLS, cells or max(1, round(math.sqrt(n)))), ROUNDS)[0]
    kind = next(f.dataType.simpleString() for f in vectors.schema if f.name == id)

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                yield pd.DataFrame({id: b[id], vector: list(x - centres[nearest(x, centres)[0]])})

    books = train(sample.mapInPandas(residuals, f"{id} {kind}, {vector} array<double>"), id, vector, parts, CODES, ROUNDS)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                at, _ = nearest(x, centres)
                codes = np.stack([nearest(r, book)[0] for r, book in zip(np.split(x - centres[at], parts, axis=1), books, strict=True)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"id": b[id], "cell": at.astype(np.int32), "code": [c.tobytes() for c in codes]})

    if n:
        coded = vectors.select(id, vector).mapInPandas(encode, f"id {kind}, cell int, code binary")
        coded.write.mode("overwrite").parquet(f"{path}/rows")
        coded = spark.read.parquet(f"{path}/rows")
        sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # a row a cell
        dealt = coded.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        rows = dealt.groupBy("cell", "piece").agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("r"))
        rows.select("cell", "piece", F.transform("r", lambda r: r["id"]).alias("ids"), F.transform("r", lambda r: r["code"]).alias("codes")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/codes")
    return Index(path, centres, books)


def _probes(queries: DataFrame, vector: str, index: Index, probes: int) -> DataFrame:
    """(query, cell, v): the nearest cells of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 512):
                x = np.stack(b[vector].iloc[s : s + 512].to_numpy()).astype(float)
                far = (index.cells**2).sum(1)[None, :] - 2 * x @ index.cells.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query": np.repeat(b["query"].iloc[s : s + 512].to_numpy(), near.shape[1]), "cell": near.reshape(-1).astype(np.int32), "v": [v for v in x for _ in range(near.shape[1])]})

    return queries.select("query", vector).mapInPandas(run, "query long, cell int, v array<double>")


def _candidates(index: Index, queries: DataFrame, vector: str, probes: int, candidates: int) -> DataFrame:
    """(query, id, rn): rows of the probed cells by their codes' distance, `candidates` of each query.

    Queries meet the pieces of their cells in blocks of some TOGETHER, so neither a cell nor a query that many share fills a task."""
    spark = queries.sparkSession
    codes = spark.read.parquet(f"{index.path}/codes")
    kind = codes.schema["ids"].dataType.elementType.simpleString()
    pieces = codes.select("cell", "piece")
    asked = _probes(queries, vector, index, probes)
    # how many queries want a cell: a row a cell
    wanted = asked.groupBy("cell").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks"))
    placed = asked.join(F.broadcast(wanted), "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
    blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("query", "v")).alias("q"))
    met = blocks.join(pieces, "cell").join(codes, ["cell", "piece"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, q, ids, coded in zip(b["cell"], b["q"], b["ids"], b["codes"], strict=True):
                x = np.stack([r["v"] for r in q]).astype(float) - index.cells[cell]
                rows = np.frombuffer(b"".join(coded), np.uint8).reshape(len(ids), -1)
                far = np.zeros((len(x), len(ids)))
                for m, (own, book) in enumerate(zip(np.split(x, len(index.books), axis=1), index.books, strict=True)):
                    look = ((own**2).sum(1)[:, None] - 2 * own @ book.T) + (book**2).sum(1)[None, :]
                    far += look[:, rows[:, m]]
                far = np.round(far, 9)
                # all that tie with the last one stay until ids decide
                i, j = np.nonzero(far <= np.partition(far, min(candidates, far.shape[1]) - 1, axis=1)[:, [min(candidates, far.shape[1]) - 1]])
                yield pd.DataFrame({"query": np.array([r["query"] for r in q])[i], "id": np.asarray(ids)[j], "far": far[i, j]})

    found = met.select("cell", "q", "ids", "codes").mapInPandas(run, f"query long, id {kind}, far double")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))).filter(F.col("rn") <= candidates).select("query", "id", "rn")


def tune(index: Index, vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> Index:
    """Set probes and candidates so that AIM of the k true neighbours of TRIED queries are within each, by their ranks: one brute-force pass for these
    queries. Both grow as the table needs it; the recall that is left is kept, and exact() is there where it is too small."""
    tried = queries.orderBy(F.xxhash64("query"), "query").limit(TRIED)
    tried.write.mode("overwrite").parquet(f"{index.path}/tried")
    tried = queries.sparkSession.read.parquet(f"{index.path}/tried")
    true = exact(vectors, id, vector, tried, k).select("query", F.col(id).alias("id"))
    rows = queries.sparkSession.read.parquet(f"{index.path}/rows").select("id", "cell")
    places = _probes(tried, vector, index, len(index.cells)).select("query", "cell", F.row_number().over(Window.partitionBy("query").orderBy(F.monotonically_increasing_id())).alias("at"))
    ranks = sorted(r["at"] for r in true.join(rows, "id").join(places, ["query", "cell"]).select("at").collect())  # TRIED * k numbers
    if not ranks:
        index.probes, index.candidates = 1, k
        return index
    index.probes = ranks[min(len(ranks) - 1, math.ceil(AIM * len(ranks)))]
    most = 1024 * k
    found = true.join(_candidates(index, tried, vector, index.probes, most), ["query", "id"], "left").select("rn").collect()
    ranks = sorted(most if r["rn"] is None else r["rn"] for r in found)
    reached = [r for r in ranks if r < most] or [k]
    index.candidates = max(k, reached[min(len(reached) - 1, math.ceil(AIM * len(reached)))])
    index.recall = sum(r <= index.candidates for r in reached) / len(ranks)
    return index


def exact(vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): the k rows of smallest squared distance to each query, by comparing it with all rows in blocks."""
    distances = lambda rows, q: (q**2).sum(1)[:, None] - 2 * q @ rows.astype(float).T + (rows.astype(float) ** 2).sum(1)[None, :]
    return best_of_blocks(vectors, id, vector, queries, vector, distances, k)


def search(index: Index, vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): for each row of queries(query, vector) the k rows of smallest squared distance among its candidates, which
    come from the nearest cells by codes; their distances are exact. tune() sets how many of either are looked at."""
    found = _candidates(index, queries, vector, index.probes, index.candidates)
    pairs = found.join(vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")), "id").join(queries.select("query", F.col(vector).alias("q")), "query")
    far = pairs.select("query", F.col("id").alias(id), F.round(squared_l2(F.col("v"), F.col("q")), 6).alias("distance"))
    return far.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("distance", id))).filter(F.col("rn") <= k).drop("rn")


def indexed(spark: SparkSession, path: str, vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """search() over a new index of all rows, tuned by some of the queries."""
    return search(tune(build(vectors, id, vector, path), vectors, id, vector, queries, k), vectors, id, vector, queries, k)
