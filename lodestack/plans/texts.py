"""Queries: filters, text functions, search, vectors, serving verbs, sinks and streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import api
from lodestack.functions import metadata as M
from lodestack.functions import text as X
from lodestack.functions import vectors as V
from lodestack.operators import filters as Q
from lodestack.operators import search as S
from lodestack.plans.duck import ENT, given, stems, words
from lodestack.plans.registry import register
from lodestack.sources import sinks
from lodestack.sources.catalogue import entities, read
from lodestack.streaming import flows

# Filters ---------------------------------------------------------------------------------------------------------------------


@register("filter_constraints", given("SELECT id, params_billions, score FROM ent WHERE type = 'model' AND (vram_gb <= 20 OR vram_gb IS NULL OR vram_gb = 0) AND (params_billions <= 40 OR params_billions IS NULL OR params_billions = 0) AND context_length >= 4096 AND lower(license) IN ('mit', 'apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'isc', 'unlicense', 'cc0-1.0', 'bsl-1.0', 'openrail') ORDER BY CASE WHEN params_billions > 0 THEN 0 ELSE 1 END, score DESC, id LIMIT 20", ENT))
def filter_constraints(spark: SparkSession, d: str) -> DataFrame:
    """F1, L6, select: constraints that let unknown values pass."""
    return api.Catalogue(entities(spark, d)).select(max_vram=20, max_params=40, min_context=4096, license="commercial", limit=20).select("id", "params_billions", "score")


@register("filter_query_language", given("SELECT id FROM ent WHERE contains(lower(author), 'brand1') AND score > 40 AND params_billions >= 7 AND contains(lower(concat_ws(' ', name, slug, author)), 'ring')", ENT))
def filter_query_language(spark: SparkSession, d: str) -> DataFrame:
    """the small query language."""
    condition = Q.parse("author:brand1 score:>40 params:>=7 ring", ["name", "slug", "author"], {"author": "author", "task": "pipeline_tag", "license": "license"}, {"params": "params_billions", "score": "score", "ctx": "context_length"})
    return entities(spark, d).filter(condition).select("id")


@register("filter_worker", given("SELECT id FROM ent WHERE likes >= 1000 AND list_has_all(tags, ['economy']) AND last_modified >= DATE '2024-02-01' - 365", ENT))
def filter_worker(spark: SparkSession, d: str) -> DataFrame:
    """likes, all tags, age."""
    return entities(spark, d).filter((F.col("likes") >= 1000) & (F.size(F.array_except(F.array(F.lit("economy")), "tags")) == 0) & (F.col("last_modified") >= F.date_sub(F.lit("2024-02-01").cast("date"), 365))).select("id")


@register("filter_valid_ids", given("SELECT id FROM ent WHERE type NOT IN ('space') AND NOT id LIKE 'gh-%' AND regexp_full_match(id, '[a-z0-9]+-[a-z]+--[a-z0-9.-]+')", ENT))
def filter_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    """cancelled types, prefixes, and the form of ids."""
    return entities(spark, d).filter(~F.col("type").isin("space") & ~F.col("id").startswith("gh-") & F.col("id").rlike("^[a-z0-9]+-[a-z]+--[a-z0-9.-]+$")).select("id")


@register("filter_qualified", given("SELECT id FROM ent WHERE NOT (id LIKE 'gh-%' OR id LIKE 'github-%') OR k % 13 = 0 OR params_billions > 0 OR k % 7 = 0 OR has_gguf", ENT))
def filter_qualified(spark: SparkSession, d: str) -> DataFrame:
    """records of code hosts need a sign of a model; others pass."""
    k = F.col("k")
    return entities(spark, d).filter(Q.qualified(F.col("id"), F.when(k % 13 == 0, "llama").otherwise(""), F.col("params_billions"), F.when(k % 7 == 0, True), F.col("has_gguf"))).select("id")


_PAGES = {"small": ("small", False, None), "medium": ("medium", False, None), "large": ("large", False, None), "gguf": (None, True, None), "commercial": (None, False, "commercial"), "open_small_gguf": ("small", True, "open")}


@register("filter_category_page", given("m AS (SELECT id, coalesce(params_billions, 0) AS p, k % 9 = 0 OR k % 11 = 0 AS g, lower(coalesce(license, '')) AS l FROM ent WHERE type = 'model') SELECT id, p < 7 AS small, p BETWEEN 7 AND 13 AS medium, p > 70 AS large, g AS gguf, contains(l, 'mit') OR contains(l, 'apache') AS commercial, p < 7 AND g AND (contains(l, 'mit') OR contains(l, 'gpl')) AS open_small_gguf FROM m", ENT))
def filter_category_page(spark: SparkSession, d: str) -> DataFrame:
    """the choices of a category page: size, weights in one file, licence."""
    k = F.col("k")
    m = entities(spark, d).filter("type = 'model'").withColumns({"tags": F.when(k % 9 == 0, F.array_append("tags", F.lit("GGUF-q4"))).otherwise(F.col("tags")), "library_name": F.when(k % 11 == 0, "gguf")})
    return m.select("id", *(Q.of_page(*choice).alias(name) for name, choice in _PAGES.items()))


@register("filter_sitemap", given("SELECT id FROM ent LEFT JOIN documents ON doc_id = k WHERE length(coalesce(text, '')) + length(coalesce(description, '')) > 3600 OR score >= 20 OR type = 'paper'", ENT))
def filter_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """what is listed: long texts, good scores, papers."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.length("text").alias("size"))
    size = F.coalesce("size", F.lit(0)) + F.coalesce(F.length("description"), F.lit(0))
    return entities(spark, d).join(texts, "k", "left").filter((size > 3600) | (F.col("score") >= 20) | (F.col("type") == "paper")).select("id")


@register("filter_content_status", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(?:scum|trash)\\b') THEN 'blocked' WHEN regexp_matches(lower(text), '\\b(?:clown|loser)\\b') THEN 'pending' ELSE 'approved' END AS status FROM documents")
def filter_content_status(spark: SparkSession, d: str) -> DataFrame:
    """F8: blocked, pending, approved."""
    return read(spark, d, "documents").select("doc_id", Q.content_status(F.col("text"), ["scum", "trash"], ["clown", "loser"]).alias("status"))


@register("filter_rules", given("r AS (SELECT id, list_filter([CASE WHEN score > 90 THEN 'top' END, CASE WHEN contains(lower(name), 'ring') AND likes > 2000 THEN 'rings' END, CASE WHEN list_contains(tags, 'bert') OR source = 'github' THEN 'code' END], lambda x: x IS NOT NULL)[1:2] AS h FROM ent) SELECT id, CASE WHEN len(h) > 0 THEN array_to_string(h, ',') ELSE 'default' END AS slots FROM r", ENT))
def filter_rules(spark: SparkSession, d: str) -> DataFrame:
    """the first two rules by priority."""
    rules = [Q.Rule("code", [("tags", "equals", "bert"), ("source", "equals", "github")], "OR", 1, frozenset({"tags"})), Q.Rule("top", [("score", "gt", 90)], priority=9), Q.Rule("rings", [("name", "contains", "ring"), ("likes", "gt", 2000)], priority=5)]
    return entities(spark, d).select("id", F.array_join(Q.first_rules(rules), ",").alias("slots"))


# Text --------------------------------------------------------------------------------------------------------------------------


_WORDS = words("text")


@register("text_words", f"SELECT doc_id, len({_WORDS}) AS n, len(list_distinct({_WORDS})) AS n_distinct FROM documents")
def text_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of a text before stemming."""
    return read(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@register("text_terms", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {stems(_WORDS)} AS t FROM documents)")
def text_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stems."""
    return read(spark, d, "documents").select("doc_id", X.terms(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


def _content_sql() -> str:
    out = "html"
    for tag in X.DROPPED_TAGS:
        out = f"regexp_replace({out}, '(?is)<{tag}.*?</{tag}>', '', 'g')"
    for pattern, by in X.CONTENT:
        pattern, by = pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", by).replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    for entity, char in X.ENTITIES.items():
        out = f"replace({out}, '{entity}', {char!r})" if char != "'" else f"replace({out}, '{entity}', chr(39))"
    return f"trim(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@register("text_main_content", f"t AS (SELECT page_id, {_content_sql()} AS t FROM pages), s AS (SELECT page_id, t, len(regexp_extract_all(t, '(?m)^#{{2,3}}\\s+\\S')) AS sections, octet_length(encode(t)) AS b FROM t) SELECT page_id, length(t) AS n, md5(t) AS digest, sections, CASE WHEN b >= 1000 AND sections >= 2 THEN 'SUCCESS' WHEN b >= 200 THEN 'PARTIAL' ELSE 'SKIP' END AS class FROM s".replace("t AS (", "WITH t AS (", 1))
def text_main_content(spark: SparkSession, d: str) -> DataFrame:
    """Page to text with its class; whole pages, however long."""
    return read(spark, d, "pages").select("page_id", X.main_content(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"), X.section_count(F.col("t")).alias("sections"), X.content_class(F.col("t")).alias("class"))


_NOTE = "CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) WHEN 1 THEN 'intro' || chr(10) || '---' || chr(10) || 'one' || chr(10) || '---' || chr(10) || 'mid' || chr(10) || '---' || chr(10) || 'two' || chr(10) || '---' || chr(10) ELSE '' END || text"


@register("text_abstracts", f"""t AS (SELECT doc_id, {_NOTE} AS text FROM documents), p AS (SELECT doc_id, regexp_replace(text, '(?m)^---[\\s\\S]*?---\\s*', '') AS t FROM t)
 SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```[\\s\\S]*?```', '', 'g'), '<[^>]+>', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*`\\[\\]]', '', 'g'), '\\s+', ' ', 'g')), 300) AS abstract FROM p""".replace("t AS (", "WITH t AS (", 1))
def text_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Short plain text; only the first block between dashes is front matter."""
    return read(spark, d, "documents").selectExpr("doc_id", f"{_NOTE.replace('chr(10)', 'char(10)')} AS text").select("doc_id", X.clean_abstract(F.col("text"), 300).alias("abstract"))


@register("text_slugs", given("SELECT id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug FROM ent", ENT))
def text_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs."""
    return entities(spark, d).select("id", X.slug(F.col("name")).alias("name_slug"))


@register("text_sections", "SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    """Structure of a page."""
    return read(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<h[1-6][^>]*>")).cast("long").alias("headings"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


@register("text_links", "SELECT page_id, string_agg(DISTINCT u, ' ' ORDER BY u) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS u FROM pages) GROUP BY page_id")
def text_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in a page, each once."""
    return read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))), " ").alias("links")).filter("links <> ''")


@register("text_hosts", "SELECT regexp_extract(url, '^https?://([^/?:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def text_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of addresses, counted."""
    return read(spark, d, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@register("text_json_repair", r"SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'C:\q\d' AS path FROM events")
def text_json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON text, after repair of its escapes; each text has two that JSON doesn't know."""
    bad = F.concat(F.lit(r'{"path": "C:\q\d", '), F.substring("props", 2, 1 << 30))
    fixed = X.repair_json(bad)
    return read(spark, d, "events").select("event_id", F.get_json_object(fixed, "$.k").cast("long").alias("k"), F.get_json_object(fixed, "$.path").alias("path"))


@register("text_citations", given("SELECT id, '@misc{' || regexp_replace(id, '[^A-Za-z0-9]+', '_', 'g') || ', title={' || name || '}, author={' || coalesce(author, 'Unknown') || '}, year={' || coalesce(CAST(year(last_modified) AS VARCHAR), 'n.d.') || '}, url={' || coalesce(source_url, '') || '}}' AS citation FROM ent WHERE type = 'paper'", ENT))
def text_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations."""
    return entities(spark, d).filter("type = 'paper'").select("id", M.bibtex(F.col("id"), F.col("name"), F.col("author"), F.year("last_modified"), F.col("source_url")).alias("citation"))


@register("text_source_urls", given("SELECT id, CASE WHEN id LIKE 'arxiv-%' THEN 'https://arxiv.org/abs/' || regexp_extract(id, '^arxiv-[a-z]+--[^-].*?--(.+)$', 1) WHEN id LIKE 'gh-%' THEN 'https://github.com/' || coalesce(author || '/' || name, regexp_extract(id, '^gh-[a-z]+--([^-].*?)--(.+)$', 1) || '/' || regexp_extract(id, '^gh-[a-z]+--([^-].*?)--(.+)$', 2)) ELSE 'https://huggingface.co/' || coalesce(author || '/' || name, regexp_extract(id, '^hf-[a-z]+--([^-].*?)--(.+)$', 1) || '/' || regexp_extract(id, '^hf-[a-z]+--([^-].*?)--(.+)$', 2)) END AS url FROM ent", ENT))
def text_source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where an entity lives."""
    return entities(spark, d).select("id", M.source_url(F.col("id"), F.col("author"), F.col("name")).alias("url"))


# Search and vectors ---------------------------------------------------------------------------------------------------------------


@register("search_document_frequency", given("SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS term FROM ent) GROUP BY term", ENT))
def search_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each word of a name; search_index has those of all texts."""
    return entities(spark, d).select(F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


_ASKED = "small rings for vision"
_POSTINGS = f"p AS (SELECT id, score, unnest({stems(words("concat_ws(' ', name, slug, author, description)"))}) AS term FROM ent), tot AS (SELECT count(DISTINCT id) AS n, count(*) / CAST(count(DISTINCT id) AS DOUBLE) AS avg_len FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"
_HITS = "h AS (SELECT p.id, sum(x) * count(*) / (SELECT len(w) FROM q) AS relevance, count(*) AS hits FROM (SELECT p.id, floor((floor(score + 0.5) * 0.6E0 + ln((n - df + 0.5E0) / (df + 0.5E0) + 1) * 2.2E0 / (1 + 1.2E0 * (0.25E0 + 0.75E0 / avg_len)) * 16) * 100 + 0.5) / 100 AS x FROM p JOIN df USING (term), tot, q WHERE list_contains(w, p.term)) p GROUP BY p.id)"


@register("search_ranked", given(f"{_POSTINGS}, q AS (SELECT {stems(words(repr(_ASKED)))} AS w), {_HITS}, best AS (SELECT * FROM h ORDER BY round(relevance, 9) DESC, id LIMIT 200) SELECT id, round(relevance, 6) AS relevance, hits, score FROM best JOIN ent USING (id) ORDER BY round(best.relevance, 9) DESC, score DESC, id LIMIT 50", ENT))
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """R2, J18, J19, search: the best entities for a query, with their rows."""
    return api.Catalogue(entities(spark, d)).search(_ASKED, limit=50).select("id", F.round("relevance", 6).alias("relevance"), "hits", "score")


@register("search_index", given(f"{_POSTINGS}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS row FROM ent), l AS (SELECT id, row, CASE WHEN row < 256 THEN 0 ELSE 1 + CAST(floor(log2(row // 256) / 2) AS INT) END AS level FROM r), c AS (SELECT id, row, CASE WHEN level = 0 THEN row // 4 ELSE level * 64 + (row - 256 * CAST(pow(4, level - 1) AS BIGINT)) // CAST(12 * pow(4, level - 1) AS BIGINT) END AS block FROM l) SELECT term, left(term, 2) AS bucket, CAST(block AS INT) AS block, count(*) AS n, max(score) AS most, arg_min(p.id, row) AS best FROM p JOIN c USING (id) GROUP BY ALL", ENT))
def search_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index: of each term and block of rows of like scores the postings, the best first, with the greatest score."""
    cat = api.Catalogue(entities(spark, d))
    path = sinks.scratch(spark, "index")
    cat.build_index(path)
    # the first chunk that a term has in a block; a rare one may have none in the first chunk of a wide block
    first = spark.read.parquet(f"{path}/postings").groupBy("term", "block").agg(F.min_by(F.get("ids", F.lit(0)), "chunk").alias("best"))
    return first.join(spark.read.parquet(f"{path}/blocks"), ["term", "block"]).select("term", "bucket", "block", "n", "most", "best")


_TYPED = "best AS (SELECT * FROM h ORDER BY round(relevance, 9) DESC, id LIMIT 200) SELECT id, round(relevance, 6) AS relevance, hits, score FROM best JOIN ent USING (id) WHERE type = '{}' ORDER BY round(best.relevance, 9) DESC, score DESC, id LIMIT {}"


@register("search_typed", given(f"{_POSTINGS}, q AS (SELECT {stems(words(repr('blue rods with retrieval')))} AS w), {_HITS}, {_TYPED.format('tool', 50)}", ENT))
def search_typed(spark: SparkSession, d: str) -> DataFrame:
    """R3, search: the candidates of a query that are of a type, without a stored index."""
    return api.Catalogue(entities(spark, d)).search("blue rods with retrieval", type="tool", limit=50).select("id", F.round("relevance", 6).alias("relevance"), "hits", "score")


@register("search_typed_stored", given(f"{_POSTINGS}, q AS (SELECT {stems(words(repr('blue rods with retrieval')))} AS w), {_HITS}, {_TYPED.format('tool', 50)}", ENT))
def search_typed_stored(spark: SparkSession, d: str) -> DataFrame:
    """R3, search: the rows of search_typed from a stored index."""
    cat = api.Catalogue(entities(spark, d))
    cat.build_index(sinks.scratch(spark, "index"))
    return cat.search("blue rods with retrieval", type="tool", limit=50).select("id", F.round("relevance", 6).alias("relevance"), "hits", "score")


@register("search_stored", given(f"{_POSTINGS}, q AS (SELECT {stems(words(repr('blue rods with retrieval')))} AS w), {_HITS}, best AS (SELECT * FROM h ORDER BY round(relevance, 9) DESC, id LIMIT 200) SELECT id, round(relevance, 6) AS relevance, hits, score FROM best JOIN ent USING (id) WHERE type = 'model' ORDER BY round(best.relevance, 9) DESC, score DESC, id LIMIT 10 OFFSET 10", ENT))
def search_stored(spark: SparkSession, d: str) -> DataFrame:
    """A query answered from the stored index, of which it reads the blocks that can hold one of the best: candidates, rows, type, page."""
    path = sinks.scratch(spark, "index")
    cat = api.Catalogue(entities(spark, d))
    cat.build_index(path)
    return cat.search("blue rods with retrieval", type="model", limit=10, page=2).select("id", F.round("relevance", 6).alias("relevance"), "hits", "score")


@register("search_postings", given("""p AS (SELECT DISTINCT k, CAST(floor(score + 0.5) AS INT) AS fs, unnest(string_split(lower(p_t), ' ')) AS term FROM (SELECT k, score, name || ' ' || type AS p_t FROM ent)), t AS (SELECT count(DISTINCT k) AS n, count(*) / CAST(count(DISTINCT k) AS DOUBLE) AS avg_len FROM p), q AS (SELECT term, count(*) AS df FROM p WHERE term IN ('ring', 'model', 'small') GROUP BY term),
 s AS (SELECT p.k, floor((fs * 0.6E0 + ln((n - df + 0.5E0) / (df + 0.5E0) + 1) * 2.2E0 / (1 + 1.2E0 * (0.25E0 + 0.75E0 / avg_len)) * 16) * 100 + 0.5) / 100 AS x FROM p JOIN q ON q.term = p.term, t) SELECT k, round(sum(x) * count(*) / 3E0, 4) AS relevance, count(*) AS hits FROM s GROUP BY k ORDER BY relevance DESC, k LIMIT 200""", ENT))
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    """R2: blended scores of postings of plain words."""
    p = entities(spark, d).select("k", "score", F.explode(F.array_distinct(F.split(F.lower(F.concat("name", F.lit(" "), "type")), " "))).alias("term"))
    hits = S.search(p, "k", "score", ["ring", "model", "small"], 10_000_000)
    return hits.select("k", F.round("relevance", 4).alias("relevance"), "hits").orderBy(F.desc("relevance"), "k").limit(200)


def _vector_queries(e: DataFrame) -> DataFrame:
    """The vectors that are searched for."""
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")


_COSINE = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v), c AS (SELECT q.vec_id AS query, r.vec_id, CASE WHEN q.n * r.n > 0 THEN round(list_dot_product(q.e, r.e) / (q.n * r.n), 6) ELSE 0 END AS similarity FROM n q JOIN n r ON q.vec_id % 50 = 0)"


@register("vector_nearest", f"{_COSINE} SELECT query, vec_id, similarity FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) <= 20")
def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Brute-force nearest vectors."""
    e = read(spark, d, "embeddings")
    return S.nearest(e, "vec_id", "embedding", _vector_queries(e), 20)


@register("vector_quantised", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127 + 0.5))) AS INT)), ',') AS bytes FROM embeddings")
def vector_quantised(spark: SparkSession, d: str) -> DataFrame:
    """Signed bytes."""
    return read(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(V.quantise(F.col("embedding")), lambda x: x.cast("string")), ",").alias("bytes"))


@register("vector_centroids", "SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY label, pos")
def vector_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Means by cluster and position."""
    return S.centroids(read(spark, d, "embeddings"), "embedding", "label").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("vector_assign", "WITH e AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings), c AS (SELECT label AS c, pos, avg(x) AS m FROM e GROUP BY label, pos), d AS (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (pos) GROUP BY vec_id, c) SELECT vec_id, arg_min(c, (d, c)) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id")
def vector_assign(spark: SparkSession, d: str) -> DataFrame:
    """The nearest centroid of each vector."""
    e = read(spark, d, "embeddings")
    c = S.centroids(e, "embedding", "label").withColumnRenamed("label", "cluster")
    return S.assign(e, "vec_id", "embedding", c, "cluster").withColumn("distance", F.round("distance", 6))


@register("vector_clusters")
def vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    """V1, V2: seeded k-means over all vectors; iterative, so tested for its invariants."""
    from lodestack.operators.clusters import kmeans

    e = read(spark, d, "embeddings")
    return S.assign(e, "vec_id", "embedding", kmeans(e, "vec_id", "embedding", 128, 20), "cluster").select("vec_id", "cluster", F.round("distance", 4).alias("distance"))


@register("vector_product_codes")
def vector_product_codes(spark: SparkSession, d: str) -> DataFrame:
    """V1, V4, V5: an inverted file over residual product codes; its candidates by asymmetric distances, the best of them by exact ones."""
    from lodestack.operators import ivf

    e = read(spark, d, "embeddings")
    return ivf.indexed(spark, sinks.scratch(spark, "cells"), e, "vec_id", "embedding", _vector_queries(e), 20)


CENTRES = "x AS (SELECT label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY label, pos), cen AS (SELECT label, list(x ORDER BY pos) AS e FROM m GROUP BY label), sim AS (SELECT q.vec_id AS query, cen.label, list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), cen.e) / (sqrt(list_sum(list_transform(cen.e, lambda x: x * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS sim FROM embeddings q, cen WHERE q.vec_id % 50 = 0), near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, label) <= 3)"


@register("vector_rerank", f"WITH {CENTRES}, best AS (SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 200) SELECT query, vec_id, label, round(least(99.9E0, sim * 100), 4) AS s FROM near JOIN best USING (label)")
def vector_rerank(spark: SparkSession, d: str) -> DataFrame:
    """V6, V7: members of the clusters nearest each query."""
    e = read(spark, d, "embeddings")
    c = S.centroids(e, "embedding", "label")
    return S.cluster_candidates(e.select("vec_id", "label"), "vec_id", "label", c, _vector_queries(e), "embedding", "vec_id").select("query", "vec_id", "label", F.round(F.least(F.lit(99.9), F.col("sim") * 100), 4).alias("s"))


@register("vector_byte_rerank", f"WITH {CENTRES}, best AS (SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 200), b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127 + 0.5))) AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 50 = 0) SELECT query, vec_id, round(CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN list_dot_product(q.e, v) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) ELSE -1 END, 6) AS similarity FROM near JOIN best USING (label) JOIN b USING (vec_id) JOIN q USING (query)")
def vector_byte_rerank(spark: SparkSession, d: str) -> DataFrame:
    """V9: members of the clusters nearest each query scored by their vectors of signed bytes, which are stored as base64 text."""
    e = read(spark, d, "embeddings")
    stored = e.select("vec_id", V.packed_bytes(F.col("embedding")).alias("text"))
    c = S.centroids(e, "embedding", "label")
    near = S.cluster_candidates(e.select("vec_id", "label"), "vec_id", "label", c, _vector_queries(e), "embedding", "vec_id").select("query", "vec_id")
    pairs = near.join(stored, "vec_id").join(_vector_queries(e), "query")
    return pairs.select("query", "vec_id", F.round(V.byte_cosine(F.col("embedding"), F.col("text")), 6).alias("similarity"))


# Verbs, sinks, streams ------------------------------------------------------------------------------------------------------------


@register("verb_compare", given("r AS (SELECT unnest(range(3)) AS pos, unnest(['brand2--small-ring', 'brand9--no-such', 'brand17--red-widget']) AS req) SELECT pos, req, CASE WHEN count(e.id) = 0 THEN 'NOT_FOUND' WHEN count(e.id) = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status, min(e.id) AS id FROM r LEFT JOIN ent e ON e.slug = r.req GROUP BY pos, req", ENT))
def verb_compare(spark: SparkSession, d: str) -> DataFrame:
    """compare, entity: requests in order, with markers."""
    out = api.Catalogue(entities(spark, d)).compare(["brand2--small-ring", "brand9--no-such", "brand17--red-widget"])
    return out.select(F.col("pos").cast("long").alias("pos"), "req", "status", "id")


@register("sink_mirror", given("SELECT id, type, left(description, 300) AS abstract, round(score, 1) AS score FROM ent", ENT))
def sink_mirror(spark: SparkSession, d: str) -> DataFrame:
    """The mirror written by epoch and read back."""
    e = entities(spark, d).select("id", "type", F.substring("description", 1, 300).alias("abstract"), F.round("score", 1).alias("score"))
    path = sinks.scratch(spark, "mirror")
    sinks.write_epoch(e, path, "e1")
    sinks.write_epoch(e, path, "e2")
    return sinks.read_latest(spark, path)


@register("sink_slots", given("SELECT CAST(CAST('0x' || substr(sha256(slug), 1, 8) AS BIGINT) % 12 AS INT) AS slot, count(*) AS n FROM ent GROUP BY 1", ENT))
def sink_slots(spark: SparkSession, d: str) -> DataFrame:
    """A table dealt by slot, read back by slot."""
    path = sinks.scratch(spark, "slots")
    sinks.write_slots(entities(spark, d).select("id", "slug"), path, F.sha2("slug", 256), 12)
    return spark.read.parquet(path).groupBy("slot").agg(F.count("*").alias("n"))


@register("sink_ndjson", given("SELECT count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(likes) AS BIGINT) AS likes FROM ent", ENT))
def sink_ndjson(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON written and read with a fixed schema, broken lines set apart."""
    path = sinks.scratch(spark, "ndjson")
    e = entities(spark, d).select("id", "likes", "tags")
    sinks.write_ndjson(e, path, 1000)
    good, bad = sinks.read_ndjson(spark, path, "id string, likes long, tags array<string>")
    return good.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("likes").alias("likes"))


@register("sink_search_pages", given("SELECT CAST(floor((row_number() OVER (PARTITION BY type ORDER BY score DESC, id) - 1) / 5000) AS INT) AS page, type, id FROM ent", ENT))
def sink_search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows in numbered files of a fixed size."""
    return sinks.numbered_pages(entities(spark, d), ["type"], [F.desc("score"), F.asc("id")], 5000).select("page", "type", "id")


@register("sink_feed", given("SELECT id, last_modified, row_number() OVER (ORDER BY last_modified DESC NULLS LAST, id) AS rn FROM ent ORDER BY rn LIMIT 50", ENT))
def sink_feed(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty, numbered."""
    from pyspark.sql import Window

    top = entities(spark, d).orderBy(F.desc_nulls_last("last_modified"), "id").limit(50)
    return top.select("id", "last_modified", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_modified"), "id")).alias("rn"))


@register("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """2.14: hourly counts of a stream with a watermark."""
    return flows.hourly(spark, d)


@register("stream_registry", "SELECT user_id, count(*) AS refreshes, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_registry(spark: SparkSession, d: str) -> DataFrame:
    """2.14, M5: micro-batches merged into a registry."""
    return flows.registry(spark, d)


@register("stream_last_scores", "SELECT user_id, least(count(*), 90) AS points, arg_max(value, event_id) AS latest FROM events GROUP BY user_id")
def stream_last_scores(spark: SparkSession, d: str) -> DataFrame:
    """2.14, W10: keyed state that keeps the last points of each id."""
    return flows.last_scores(spark, d)


@register("stream_dedupe", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """2.14: resume state as deduplication by id."""
    return flows.deduplicated(spark, d)
