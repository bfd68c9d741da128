"""The query verbs over a catalogue of entities: search, rank, select, explain, compare, entity, trends, concepts, badge, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import metadata as M
from lodestack.functions import scoring as S
from lodestack.operators import filters as Q
from lodestack.operators import rank as R
from lodestack.operators import search as I
from lodestack.sources import sinks

MAX_RESULTS = 50
#: Rows that a search keeps before types and pages.
CANDIDATES = 200
MAX_IDS = 25
#: What each sort orders by, largest first; the rest of the order is the same for all.
_REST = ("score", "raw_pop")
SORTS = {
    "relevance": ("relevance", *_REST), "score": _REST, "likes": ("likes", *_REST), "downloads": ("downloads", *_REST), "last_updated": ("last_modified", *_REST),
    **{f: (f"f_{f}", *_REST) for f in "sapqr"},
}


class Catalogue:
    """entities needs id, slug, name, type, score; verbs use further columns where they are there. Each verb returns a DataFrame
    and leaves the plan to Spark; pages and limits are checked before anything runs."""

    def __init__(self, entities: DataFrame, history: DataFrame | None = None, index: str | None = None):
        self.entities, self.history, self.index = entities, history, index

    def build_index(self, path: str) -> None:
        """Store the words of all entities under path; search() then reads only the blocks that can hold one of its best."""
        text = F.concat_ws(" ", *(c for c in ("name", "slug", "author", "description") if c in self.entities.columns))
        I.write_index(self.entities, "id", text, "score", path)
        self.index = path

    def _hits(self, wanted: list[str]) -> list[Row]:
        """The CANDIDATES best rows of all types, the same with and without a stored index."""
        if self.index:
            return I.search_index(self.entities.sparkSession, self.index, "id", "score", wanted, CANDIDATES)[0]
        text = F.concat_ws(" ", *(c for c in ("name", "slug", "author", "description") if c in self.entities.columns))
        return I.search(I.inverted_index(self.entities, "id", text, "score"), "id", "score", wanted, CANDIDATES).collect()

    def search(self, query: str, type: str | None = None, sort: str = "relevance", limit: int = 20, page: int = 1) -> DataFrame:
        """The best entities for the words of a query; without one that counts, or where none hits, all of them by score.

        A type is chosen among the CANDIDATES best of all types, whose statistics count; so a rare type may have fewer rows than there are."""
        if not 1 <= limit <= MAX_RESULTS or page < 1:
            raise ValueError(f"limit must be 1 to {MAX_RESULTS}, page 1 or more")
        wanted = I.query_terms(self.entities.sparkSession, query)
        rows = self.entities if type is None else self.entities.filter(F.col("type") == type)
        found = self._hits(wanted) if wanted else []
        if found:
            rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, f"id {rows.schema['id'].dataType.simpleString()}, relevance double, hits long")), "id")
        else:
            rows = rows.withColumns({"relevance": F.col("score"), "hits": F.lit(0)})
        columns = SORTS[sort]
        return rows.orderBy(*(F.desc_nulls_last(c) for c in columns if c in rows.columns), "id").offset((page - 1) * limit).limit(limit)

    def rank(self, task: str, query: str = "", limit: int = 20) -> DataFrame:
        """The best entities for a task and words together."""
        return self.search(f"{task} {query}", limit=limit)

    def select(self, task: str | None = None, limit: int = 20, **constraints) -> DataFrame:
        """Entities that meet all constraints, those of known size first."""
        if not 1 <= limit <= 20:
            raise ValueError("limit must be 1 to 20")
        rows = self.entities.filter("type = 'model'").filter(Q.constraints(task, **constraints))
        return rows.orderBy(F.when(F.col("params_billions") > 0, 0).otherwise(1), F.desc("score"), "id").limit(limit)

    def explain(self, days: str | None = None) -> DataFrame:
        """The factors of each entity's score and the one that adds most; semantic similarity is neutral outside a search."""
        c = F.col
        pop = S.raw_popularity(c("id"), c("likes"), c("downloads"), c("stars"), c("forks"), c("citations"))
        complete = S.completeness(c("type"), F.lit(0), c("source_url").isNotNull(), c("citations"), c("params_billions").isNotNull(), F.size("tags") > 0, c("author"))
        useful = S.utility(c("has_ollama") | c("has_gguf") | c("pipeline_tag").isNotNull(), F.lit(False))
        parts = S.factors(c("id"), c("type"), pop, c("mesh_points"), c(days) if days else F.lit(None).cast("int"), complete, useful)
        return self.entities.select("id", *(v.alias(k) for k, v in parts.items()), S.dominant_factor(parts).alias("dominant"), S.composite(parts).alias("total"))

    def compare(self, requests: Sequence[str]) -> DataFrame:
        """(pos, req, status, id, candidates): a row per request in its order; OK, NOT_FOUND or AMBIGUOUS, by id or slug."""
        if not 2 <= len(requests) <= MAX_IDS:
            raise ValueError(f"2 to {MAX_IDS} ids")
        wanted = self.entities.sparkSession.createDataFrame(list(enumerate(requests)), "pos int, req string")
        forms = self.entities.select("id", F.explode(F.array_distinct(F.array("id", "slug"))).alias("req"))
        found = forms.join(F.broadcast(wanted), "req").groupBy("pos").agg(F.min("id").alias("id"), F.countDistinct("id").alias("candidates"))
        out = wanted.join(found, "pos", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        return out.withColumn("status", F.when(F.col("candidates") == 0, "NOT_FOUND").when(F.col("candidates") == 1, "OK").otherwise("AMBIGUOUS"))

    def entity(self, id: str) -> DataFrame:
        return self.entities.filter((F.col("id") == id) | (F.col("slug") == id)).orderBy((F.col("id") == id).desc(), "type", "id").limit(MAX_IDS)

    def lookup(self, request: str) -> DataFrame:
        """One row (req, status, id): 200 for the id itself or the only entity of a slug, 409 for a slug of several, 404 for none."""
        found = self.entities.filter((F.col("id") == request) | (F.col("slug") == request))
        n, own = F.countDistinct("id").alias("n"), F.max(F.when(F.col("id") == request, F.col("id"))).alias("own")
        row = found.agg(n, own, F.min("id").alias("first"))
        status = F.when(F.col("n") == 0, 404).when(F.col("own").isNotNull() | (F.col("n") == 1), 200).otherwise(409)
        return row.select(F.lit(request).alias("req"), status.alias("status"), F.when(status == 200, F.coalesce("own", "first")).alias("id"))

    def trends(self, ids: Sequence[object]) -> DataFrame:
        """Trend rows of up to 25 ids; ids without two points have nulls."""
        if self.history is None or len(ids) > MAX_IDS:
            raise ValueError(f"needs a history and at most {MAX_IDS} ids")
        wanted = self.history.sparkSession.createDataFrame([(x,) for x in ids], f"id {self.history.schema['id'].dataType.simpleString()}")
        rows = self.history.join(F.broadcast(wanted), "id", "left_semi")
        return wanted.join(R.trends(rows, "id", "day", "score"), "id", "left")

    def concepts(self, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        rows = self.entities if category is None else self.entities.filter(F.col("primary_category") == category)
        total = rows.agg(F.count("*").alias("total"))
        return rows.orderBy("id").offset(offset).limit(limit).select("id", "name").crossJoin(total).withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))

    def badge(self, id: str) -> DataFrame:
        return self.entity(id).limit(1).select("id", "score", M.badge_colour(F.col("score")).alias("colour"), M.badge_label(F.col("score")).alias("label"))

    def health(self) -> DataFrame:
        return self.entities.agg(F.count("*").alias("entities"), F.countDistinct("type").alias("types"), F.max("last_modified").alias("latest"))


def datasets(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """(name, rows) of the latest epoch of each export under path."""
    out = None
    for name in names:
        one = sinks.read_latest(spark, f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
