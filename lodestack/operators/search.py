"""Search: inverted index, blended scoring, vector lookup, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.scoring import bm25
from lodestack.functions.text import terms, terms_of
from lodestack.functions.vectors import cosine
from lodestack.sources.sinks import numbered

#: Query vectors that are compared with all rows at a time.
QUERIES = 1024
#: Clusters that are sent to the tasks at most.
MOST_CLUSTERS = 65_536


def inverted_index(df: DataFrame, id: str, text, score: str) -> DataFrame:
    """(term, id, score): a posting for each distinct stem of a row; a null score is 0."""
    return df.select(id, F.coalesce(F.col(score), F.lit(0.0)).alias(score), F.explode(terms(text)).alias("term"))


def index_statistics(postings: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """(term, df), and one row (total_docs, avg_len)."""
    return postings.groupBy("term").agg(F.count("*").alias("df")), postings.groupBy(id).agg(F.count("*").alias("n")).agg(F.count("*").alias("total_docs"), F.avg("n").alias("avg_len"))


def bucket_of(term: Column) -> Column:
    """The first two characters of a term, which name its part of a stored index."""
    return F.substring(term, 1, 2)


#: Rows of the first level of a stored index, blocks of a level, and rows of which a chunk holds the postings of a term.
FIRST, GRID, CHUNK_ROWS = 256, 64, 4096


def block_of(row: Column) -> tuple[Column, Column]:
    """(block, chunk in it) of a row by its number in the order of scores. The first level has FIRST rows, and each later one three times all
    before it; a level has GRID blocks, so the best rows lie in narrow blocks and N rows make about 64 * log4(N / 64) of them."""
    bits = F.length(F.bin(F.floor(row / FIRST)))
    level = F.when(row < FIRST, 0).otherwise(F.floor((bits + 1) / 2)).cast("int")
    start = F.when(level == 0, 0).otherwise(F.pow(F.lit(4.0), level - 1) * FIRST).cast("long")
    width = F.when(level == 0, FIRST // GRID).otherwise(F.pow(F.lit(4.0), level - 1) * (3 * FIRST // GRID)).cast("long")
    inside = row - start
    return (level * GRID + F.floor(inside / width)).cast("int"), F.floor(F.pmod(inside, width) / CHUNK_ROWS).cast("long")


def write_index(df: DataFrame, id: str, text, score: str, path: str) -> None:
    """An index of df under path, the postings of each term in blocks of rows of like scores, the best first.

    Rows are numbered by falling score, by ranges, and cut into blocks (block_of). A row of postings/ is a chunk: the ids and scores
    of a term's rows in a part of a block, in that order; chunks lie by bucket of the term, sorted by term and block. blocks/ has the greatest score and
    the numbers of postings and chunks of each term and block; terms/ and totals/ have the statistics of all rows. A frequent term is spread over tasks by block."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(df.select(F.col(id).alias("id"), F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("score"), terms(text).alias("terms")), [F.desc("score"), F.asc("id")])
    block, chunk = block_of(F.col("row"))
    each = rows.select("row", "id", "score", block.alias("block"), chunk.alias("chunk"), F.explode("terms").alias("term"))
    chunks = each.groupBy("term", "block", "chunk").agg(F.array_sort(F.collect_list(F.struct("row", "id", "score"))).alias("p"))
    out = chunks.select("term", "block", "chunk", F.size("p").alias("n"), F.get("p", F.lit(0))["score"].alias("most"), F.transform("p", lambda x: x["id"]).alias("ids"), F.transform("p", lambda x: x["score"]).alias("scores"), bucket_of(F.col("term")).alias("bucket"))
    out.repartition(parts, "bucket", F.pmod(F.xxhash64("term", "block"), F.lit(4))).sortWithinPartitions("bucket", "term", "block", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    found = spark.read.parquet(f"{path}/postings")
    blocks = found.groupBy("bucket", "term", "block").agg(F.max("most").alias("most"), F.sum("n").alias("n"), F.count("*").alias("chunks"))
    blocks.repartition(parts, "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    rows.agg(F.count_if(F.size("terms") > 0).alias("total_docs"), F.avg(F.when(F.size("terms") > 0, F.size("terms"))).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/totals")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems of a query; its stop words don't count."""
    return terms_of(query)


class Read(NamedTuple):
    """How much of the chosen terms' postings a search read."""

    chunks: int
    of_chunks: int
    postings: int
    of_postings: int
    rounds: int


def _blended(score: Column, weight: Column) -> Column:
    return F.floor((F.floor(score + 0.5) * 0.6 + weight * 40 * 0.4) * 100 + 0.5) / 100


def search_index(spark: SparkSession, path: str, id: str, score: str, wanted: list[str], k: int = 200) -> tuple[list[Row], Read]:
    """The rows of search() from a stored index, and how much of it was read.

    A block's bound is the relevance of a row with the greatest score of each term that the block has. Blocks are read by falling
    bound, each round twice the postings of the one before, until the k-th best row found is better than the bound of every block left; a row's postings all lie in one
    block, so what is found is exact. The driver sees the blocks of the terms, some hundreds each whatever the number of rows, and k rows a round."""
    bucket = F.col("bucket").isin(sorted({w[:2] for w in wanted}))
    known = {r["term"]: r for r in _weights(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals"), wanted).collect()}
    seen: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/blocks").filter(bucket & F.col("term").isin(wanted)).collect():
        seen.setdefault(r["block"], []).append(r)
    blend = lambda r: math.floor((math.floor(r["most"] + 0.5) * 0.6 + known[r["term"]]["weight"] * 40 * 0.4) * 100 + 0.5) / 100
    bound = {b: round(sum(map(blend, rs)) * (len(rs) / len(wanted) if len(wanted) > 1 else 1.0), 9) + 1e-9 for b, rs in seen.items()}
    left = sorted(seen, key=lambda b: (-bound[b], b))
    best: list[Row] = []
    room, rounds, read, postings_read = 2 * k, 0, 0, 0
    weights = spark.createDataFrame([(t, r["weight"]) for t, r in known.items()], "term string, weight double")
    kind = next(f.dataType.elementType.simpleString() for f in spark.read.parquet(f"{path}/postings").schema if f.name == "ids")
    while left and (len(best) < k or bound[left[0]] >= best[-1]["relevance"]):
        take, size = [], 0
        while left and (not take or size < room) and (len(best) < k or bound[left[0]] >= best[-1]["relevance"]):
            take.append(left.pop(0))
            size += sum(r["n"] for r in seen[take[-1]])
        read += sum(r["chunks"] for b in take for r in seen[b])
        rounds, postings_read = rounds + 1, postings_read + size
        chunks = spark.read.parquet(f"{path}/postings").filter(bucket & F.col("term").isin(wanted) & F.col("block").isin(take))
        postings = chunks.select("term", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("term", F.col("p.ids").alias(id), F.col("p.scores").alias(score))
        found = _relevant(postings, id, score, weights, len(wanted))
        if best:
            found = found.unionByName(spark.createDataFrame(best, f"{id} {kind}, relevance double, hits long"))
        best = found.orderBy(F.desc("relevance"), id).limit(k).collect()
        room *= 2
    every = [r for rs in seen.values() for r in rs]
    return best, Read(read, sum(r["chunks"] for r in every), postings_read, sum(r["n"] for r in every), rounds)


def _weights(df: DataFrame, totals: DataFrame, wanted: list[str]) -> DataFrame:
    """(term, weight) of the wanted terms: a row per term."""
    return df.filter(F.col("term").isin(wanted)).crossJoin(totals).select("term", bm25(F.col("df"), F.col("total_docs"), F.col("avg_len")).alias("weight"))


def _relevant(postings: DataFrame, id: str, score: str, weights: DataFrame, wanted: int) -> DataFrame:
    """(id, relevance, hits) of all rows that have one of the terms."""
    per_term = postings.join(F.broadcast(weights), "term")  # a row per term of the query
    hits = per_term.groupBy(id).agg(F.sum(_blended(F.col(score), F.col("weight"))).alias("sum"), F.count("*").alias("hits"))
    return hits.select(id, F.round(F.col("sum") * (F.col("hits") / wanted if wanted > 1 else F.lit(1.0)), 9).alias("relevance"), "hits")


def search(postings: DataFrame, id: str, score: str, wanted: list[str], k: int = 200, statistics: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, relevance, hits): the k best rows for the terms. A term adds 0.6 of the row's own score and 16 times its BM25, two
    decimals; the sum is scaled by the share of the terms that hit."""
    df, totals = statistics or index_statistics(postings, id)
    found = _relevant(postings.filter(F.col("term").isin(wanted)), id, score, _weights(df, totals, wanted), len(wanted))
    return found.orderBy(F.desc("relevance"), id).limit(k)


def best_of_blocks(rows: DataFrame, id: str, column: str, queries: DataFrame, vector: str, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> DataFrame:
    """(query, id, distance): the k rows of smallest distances(rows, query vectors), rounded to six decimals, for each row of
    queries(query, vector). All rows are read for each QUERIES queries; a task returns its own best."""
    out, block = [], []

    def search(block: list) -> DataFrame:
        asked, q = np.array([r["query"] for r in block]), np.array([r[vector] for r in block], float)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                if not len(b):
                    continue
                d = np.round(distances(np.stack(b[column].to_numpy()), q), 6)
                n = min(k, d.shape[1]) - 1
                # all that tie with the k-th stay until ids decide
                i, j = np.nonzero(d <= np.partition(d, n, axis=1)[:, [n]])
                at, ids, best = np.concatenate([at, i]), np.concatenate([ids, b[id].to_numpy()[j]]), np.concatenate([best, d[i, j]])
                order = np.lexsort((ids, best, at))
                at, ids, best = at[order], ids[order], best[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, ids, best = at[first], ids[first], best[first]
            yield pd.DataFrame({"query": asked[at], id: ids, "distance": best})

        return rows.select(id, column).mapInPandas(run, f"query long, {id} long, distance double")

    for row in queries.select("query", vector).toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            out.append(search(block))
            block = []
    if block or not out:
        out.append(search(block) if block else rows.sparkSession.createDataFrame([], f"query long, {id} long, distance double"))
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("distance", id))).filter(F.col("rn") <= k).drop("rn")


def nearest(vectors: DataFrame, id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity): the k rows most alike to each of queries(query, vector), by cosine over all rows; 0 where either has no length."""

    def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        return -np.divide(q @ rows.T, norms, out=np.zeros_like(norms), where=norms > 0)

    return best_of_blocks(vectors, id, vector, queries, vector, distances, k).select("query", id, (-F.col("distance")).alias("similarity"))


def centroids(vectors: DataFrame, vector: str, cluster: str) -> DataFrame:
    """(cluster, centroid): means by position; one Lloyd step when cluster is an assignment."""
    each = vectors.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("centroid"))


def assign(vectors: DataFrame, id: str, vector: str, cents: DataFrame, cluster: str) -> DataFrame:
    """(id, cluster, distance): the nearest centroid by squared distance, the lowest number of equals; cents is a row per cluster, MOST_CLUSTERS
    at most, which are sent to the tasks. Each row is decided where it is read."""
    few = cents.select(cluster, "centroid").orderBy(cluster).limit(MOST_CLUSTERS + 1).toPandas()
    if len(few) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    names, points = few[cluster].to_numpy(), np.array(few["centroid"].tolist(), float).reshape(len(few), -1)
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *cents.schema)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b[vector].tolist(), float).reshape(len(b), -1)
            best, at = np.full(len(b), np.inf), np.zeros(len(b), np.int64)
            for k, c in enumerate(points):
                d = ((x - c) ** 2).sum(axis=1)
                nearer = d < best
                best[nearer], at[nearer] = d[nearer], k
            yield pd.DataFrame({id: b[id], cluster: names[at], "distance": best})

    return vectors.select(id, vector).mapInPandas(run, f"{id} {kinds[id]}, {cluster} {kinds[cluster]}, distance double")


def cluster_candidates(members: DataFrame, id: str, cluster: str, cents: DataFrame, queries: DataFrame, vector: str, order: str, clusters: int = 3, each: int = 200) -> DataFrame:
    """Members of the clusters nearest each of queries(query, vector), the best of each cluster."""
    sims = queries.crossJoin(F.broadcast(cents)).select("query", cluster, cosine(F.col("centroid"), F.col(vector)).alias("sim"))  # a row per cluster on the right
    near = sims.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), cluster))).filter(F.col("rn") <= clusters).drop("rn")
    best = members.withColumn("rn", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(order), id))).filter(F.col("rn") <= each).drop("rn")
    return near.join(best, cluster)
