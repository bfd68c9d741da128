"""Queries: sources read in all their forms, and tables written, versioned and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import merge as M
from lodestack.operators import rank as R
from lodestack.plans.duck import ENT, HIST, RAW, given
from lodestack.plans.registry import register
from lodestack.sources import pages, readers, sinks
from lodestack.sources.catalogue import entities, history, raw_records, read

_KINDS = "CASE k % 5 WHEN 0 THEN '.parquet' WHEN 1 THEN '.json.zst' WHEN 2 THEN '.json.gz' WHEN 3 THEN '.json' ELSE '.tmp' END"


#: Rows of a search shard, of a file of the registry, and lines of a sitemap.
SHARD_ROWS, REGISTRY_ROWS, SITEMAP_LINES = 5000, 1000, 45_000


@register("source_shards", given(f"f AS (SELECT 'base/part-' || CAST(k % 60 AS VARCHAR) || {_KINDS} AS path, k % 60 AS shard, k % 5 AS kind FROM ent) SELECT shard, arg_min(path, kind) AS path FROM f WHERE kind < 4 GROUP BY shard", ENT))
def source_shards(spark: SparkSession, d: str) -> DataFrame:
    """Of the files of each shard the one of the best kind."""
    files = entities(spark, d).selectExpr(f"'base/part-' || CAST(k % 60 AS STRING) || {_KINDS} AS path").distinct()
    return readers.preferred_shards(files)


@register("source_projections", given("SELECT 'slim' AS kind, count(*) AS n, count(DISTINCT slug) AS slugs, round(sum(score), 6) AS score FROM ent WHERE k % 12 < 3 UNION ALL SELECT 'full', count(*), count(DISTINCT slug), round(sum(score), 6) FROM ent WHERE k % 12 < 3", ENT))
def source_projections(spark: SparkSession, d: str) -> DataFrame:
    """A registry of several files, of which a range of shards is read, slim or full, at its latest epoch."""
    path = sinks.scratch(spark, "registry")
    e = entities(spark, d).withColumn("shard", F.col("k") % 12)
    sinks.write_epoch(e.limit(1), path, "e9")
    e.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/epoch=e10")
    out = None
    for kind, columns in (("slim", ["slug", "score", "shard"]), ("full", e.columns)):
        part = sinks.read_latest(spark, path).select(*columns).filter("shard BETWEEN 0 AND 2")
        one = part.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.countDistinct("slug").alias("slugs"), F.round(F.sum("score"), 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@register("source_json_documents", given("SELECT id, likes, array_to_string(tags, ',') AS tags FROM ent", ENT))
def source_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold an array, an object with entities, or a single object."""
    path = sinks.scratch(spark, "documents")
    e = entities(spark, d).select("k", F.struct("id", "likes", "tags").alias("e"))
    group = e.groupBy((F.col("k") % 7).alias("g"), F.when(F.col("k") % 7 < 5, F.col("k") % 3).otherwise(F.col("k")).alias("h"))
    docs = group.agg(F.collect_list("e").alias("es")).select("g", F.when(F.col("g") < 3, F.to_json("es")).when(F.col("g") < 5, F.to_json(F.struct(F.col("es").alias("entities")))).otherwise(F.to_json(F.col("es")[0])).alias("value"))
    # one document a file
    docs.select("value").repartition(8).write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)
    return readers.read_json_documents(spark, path, "id string, likes long, tags array<string>").select("id", "likes", F.array_join("tags", ",").alias("tags"))


@register("source_assertions", given("SELECT k AS a, k + 1 AS b, 'slug' AS method FROM ent WHERE k % 4 = 0", ENT))
def source_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of assertions, of which those of one relation between two different members count; broken lines are passed over."""
    path = sinks.scratch(spark, "assertions")
    k = F.col("k").cast("string")
    line = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"relation":"SAME_AS","member_a":'), k, F.lit(',"member_b":'), (F.col("k") + 1).cast("string"), F.lit(',"method":"slug"}')))
    line = F.coalesce(line, F.when(F.col("k") % 4 == 1, F.concat(F.lit('{"relation":"MANIFESTATION_OF","member_a":'), k, F.lit(',"member_b":1}'))).when(F.col("k") % 4 == 2, F.concat(F.lit('{"relation":"SAME_AS","member_a":'), k, F.lit(',"member_b":'), k, F.lit("}"))).otherwise("{broken"))
    entities(spark, d).select(line.alias("value")).write.mode("overwrite").text(path)
    return readers.read_assertions(spark, path)


@register("source_hot", given("SELECT type, count(*) AS n, max(score) AS best FROM ent WHERE score > 50 GROUP BY type", ENT))
def source_hot(spark: SparkSession, d: str) -> DataFrame:
    """The hot part of a table, written apart with Bloom filters of its ids, and scanned."""
    path = sinks.scratch(spark, "hot")
    hot = entities(spark, d).filter("score > 50").select("id", "type", "score")
    hot.write.option("parquet.bloom.filter.enabled#id", "true").mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@register("source_history", given("s AS (SELECT id, day, score, 0 AS shard FROM hist UNION ALL SELECT id, day, score + 1, 1 FROM hist WHERE id % 3 = 0) SELECT id, day, round(arg_max(score, shard), 6) AS score FROM s GROUP BY id, day", HIST))
def source_history(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a history, of which the last one wins for each id and day."""
    h = history(spark, d)
    both = h.withColumn("shard", F.lit(0)).unionByName(h.filter("id % 3 = 0").select("id", "day", (F.col("score") + 1).alias("score"), F.lit(1).alias("shard")))
    return M.first_by(both, ["id", "day"], [F.desc("shard")]).select("id", "day", F.round("score", 6).alias("score"))


@register("source_normalised", given("SELECT id, coalesce(name, title, display_name) AS name, coalesce(author, creator) AS author, coalesce(last_modified, last_updated) AS updated, 'hub' AS source FROM raw", ENT, RAW))
def source_normalised(spark: SparkSession, d: str) -> DataFrame:
    """A source's records under the columns of entities."""
    aliases = {"id": ["id"], "name": ["name", "title", "display_name"], "author": ["author", "creator", "no_such"], "updated": ["last_modified", "last_updated"]}
    return readers.normalise_source(raw_records(spark, d), aliases, "hub")


def _write_pages(spark: SparkSession, d: str, path: str) -> None:
    """Pages of 500 records; every 97th record has no id, and the page after each seventh is cut short."""
    k = F.col("k")
    item = F.to_json(F.struct(F.when(k % 97 > 0, F.col("id")).alias("id"), "name", "author"))
    page = entities(spark, d).groupBy(F.expr("k div 500").alias("page")).agg(F.concat(F.lit('{"items":['), F.array_join(F.array_sort(F.collect_list(item)), ","), F.when(F.col("page") % 7 == 6, "").otherwise("]}")).alias("value"))
    page.write.partitionBy("page").text(path)


_PAGES = "p AS (SELECT k, k // 500 AS page, id, name, author FROM ent)"


@register("source_pages", given(f"{_PAGES} SELECT page, id, name, author FROM p WHERE k % 97 > 0 AND page % 7 < 6", ENT))
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records of a paged source, read as a table."""
    path = sinks.scratch(spark, "pages")
    _write_pages(spark, d, path)
    good = pages.read(spark, path).filter("NOT bad").select("page", F.from_json("record", "id string, name string, author string").alias("r"))
    return good.select("page", "r.*")


@register("stream_pages", given(f"{_PAGES} SELECT page, CASE WHEN page % 7 = 6 THEN 1 ELSE count(*) END AS declared, CASE WHEN page % 7 = 6 THEN 0 ELSE count(CASE WHEN k % 97 > 0 THEN 1 END) END AS parsed, CASE WHEN page % 7 = 6 THEN 1 ELSE count(CASE WHEN k % 97 = 0 THEN 1 END) END AS dropped FROM p GROUP BY page", ENT))
def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """S19, A14, 2.14: a paged source as a stream with committed offsets, and what of each page could be parsed."""
    path = sinks.scratch(spark, "pages")
    _write_pages(spark, d, f"{path}/in")
    pages.drain(spark, f"{path}/in", f"{path}/out", f"{path}/progress")
    return pages.accounts(spark.read.parquet(f"{path}/out"))


@register("source_feeds", given("SELECT '2401.' || lpad(CAST(k AS VARCHAR), 5, '0') AS id, 'On A & B ' || name AS title, 'Ann, Bo' AS authors, 'cs.AI, cs.CL' AS categories, DATE '2024-01-01' + CAST(k % 28 AS INT) AS published FROM ent WHERE type = 'paper'", ENT))
def source_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Entries of Atom feeds."""
    e = entities(spark, d).filter("type = 'paper'")
    number = F.concat(F.lit("2401."), F.lpad(F.col("k").cast("string"), 5, "0"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 28).cast("int")).cast("string")
    xml = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/"), number, F.lit("v2</id><title>On A &amp; B\n  "), "name", F.lit('</title><summary>s</summary><author><name>Ann</name></author><author><name> Bo </name></author><category term="cs.AI"/><category term="cs.CL"/><category term="cs.AI"/><published>'), day, F.lit("T10:00:00Z</published></entry></feed>"))
    return readers.atom_entries(e.select(xml.alias("xml")), "xml").select("id", "title", F.array_join("authors", ", ").alias("authors"), F.array_join("categories", ", ").alias("categories"), "published")


@register("source_parse_report", given("SELECT 'part-' || CAST(k % 4 AS VARCHAR) AS file, count(*) AS declared, count(CASE WHEN k % 9 > 0 THEN 1 END) AS parsed, count(CASE WHEN k % 9 = 0 THEN 1 END) AS dropped FROM ent GROUP BY 1", ENT))
def source_parse_report(spark: SparkSession, d: str) -> DataFrame:
    """What of each file could be parsed, and what was lost."""
    line = F.when(F.col("k") % 9 == 0, F.concat(F.lit('{"id": "'), "id")).otherwise(F.to_json(F.struct("id", "likes")))
    lines = entities(spark, d).select(F.concat(F.lit("part-"), (F.col("k") % 4).cast("string")).alias("file"), line.alias("value"))
    return readers.parse_report(lines, "value", "id string, likes long", "file")


@register("sink_core_shards", given("SELECT rn // 5000 AS shard, count(*) AS n, min(score) AS least, max(score) AS most FROM (SELECT score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rn FROM ent) GROUP BY 1", ENT))
def sink_core_shards(spark: SparkSession, d: str) -> DataFrame:
    """K7, L4: rows in the order of the score in numbered shards, with a manifest; the first shard is the core."""
    rows = sinks.numbered(entities(spark, d).select("id", "score"), [F.desc("score"), F.asc("id")])
    path = sinks.scratch(spark, "core")
    rows.withColumn("shard", F.floor(F.col("row") / SHARD_ROWS)).write.partitionBy("shard").mode("overwrite").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@register("sink_registry", given("SELECT id, likes, CAST(NULL AS VARCHAR) AS body, true AS small FROM ent", ENT))
def sink_registry(spark: SparkSession, d: str) -> DataFrame:
    """K9: a registry without its heavy columns, in files of at most a thousand rows; here its rows as they are read back."""
    path = sinks.scratch(spark, "registry")
    entities(spark, d).drop("description").write.option("maxRecordsPerFile", REGISTRY_ROWS).mode("overwrite").json(path)
    back = spark.read.schema("id string, likes long, description string").json(path)
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).agg((F.max("n") <= REGISTRY_ROWS).alias("small"))
    return back.select("id", "likes", F.col("description").alias("body")).crossJoin(F.broadcast(files))  # one row


@register("sink_versions", given("SELECT 3 AS version, count(*) AS n FROM ent WHERE k % 4 = 0 UNION ALL SELECT 4, count(*) FROM ent UNION ALL SELECT 5, count(*) FROM ent WHERE k % 2 = 0", ENT))
def sink_versions(spark: SparkSession, d: str) -> DataFrame:
    """K11, incremental skip: a version is written only if rows have changed, and three are kept."""
    path = sinks.scratch(spark, "versions")
    e = entities(spark, d).select("id", "score", "k")
    for part in (e.filter("k % 3 = 0"), e.filter("k % 3 = 0").orderBy(F.desc("k")), e.filter("k % 5 = 0"), e.filter("k % 4 = 0"), e, e.repartition(3), e.filter("k % 2 = 0")):
        sinks.write_if_changed(part, path)
    found = spark.read.parquet(path)
    return found.groupBy(F.regexp_replace("epoch", "^e", "").cast("int").alias("version")).agg(F.count("*").alias("n"))


@register("sink_copy_on_write", given("v AS (SELECT 1 AS version, id, score FROM ent WHERE k % 3 < 2 UNION ALL SELECT 2, id, CASE WHEN k % 100 = 7 THEN score + 1 ELSE score END FROM ent WHERE k % 3 < 2 OR k % 100 = 7) SELECT version, count(*) AS n, round(sum(score), 3) AS total, version = 2 AS shares FROM v GROUP BY version", ENT))
def sink_copy_on_write(spark: SparkSession, d: str) -> DataFrame:
    """A batch of a hundredth merged into a table; the version before stays readable, and shares the buckets that haven't changed."""
    from lodestack.sources import versions

    path, e = sinks.scratch(spark, "table"), entities(spark, d)
    versions.upsert(e.filter("k % 3 < 2").select("id", "score"), path, "id")
    versions.upsert(e.filter("k % 100 = 7").select("id", (F.col("score") + 1).alias("score")), path, "id")
    out = None
    for v in (1, 2):
        entries = versions.manifest(spark, path, v).agg((F.min("version") < v).alias("shares"))
        one = versions.read(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total")).crossJoin(F.broadcast(entries))  # a row each
        out = one if out is None else out.unionByName(one)
    return out


@register("sink_sitemap", given("SELECT source_url AS loc, max(CASE WHEN score >= 80 THEN '0.9' ELSE '0.5' END) AS priority, true AS split FROM ent WHERE source_url IS NOT NULL GROUP BY source_url", ENT))
def sink_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, each once, in files of at most 45,000 lines, with an index of the files; here the lines as they are read back."""
    e = entities(spark, d).filter("source_url IS NOT NULL").groupBy("source_url").agg(F.max(F.when(F.col("score") >= 80, "0.9").otherwise("0.5")).alias("priority"))
    lines = e.select(F.concat(F.lit("<url><loc>"), "source_url", F.lit("</loc><priority>"), "priority", F.lit("</priority></url>")).alias("value"))
    path = sinks.scratch(spark, "sitemap")
    index = sinks.write_in_files(lines, path, SITEMAP_LINES).agg((F.max("rows") <= SITEMAP_LINES).alias("split"))
    part = lambda tag: F.regexp_extract("value", f"<{tag}>(.*)</{tag}>", 1)
    return spark.read.text(path).select(part("loc").alias("loc"), part("priority").alias("priority")).crossJoin(F.broadcast(index))  # one row


@register("sink_items", given("SELECT '<item><title>' || replace(replace(name, '&', '&amp;'), '<', '&lt;') || '</title><link>' || coalesce(source_url, '') || '</link><pubDate>' || strftime(last_modified, '%Y-%m-%d') || 'T00:00:00Z</pubDate></item>' AS item FROM ent WHERE last_modified IS NOT NULL ORDER BY last_modified DESC, id LIMIT 50", ENT))
def sink_items(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty as items of a feed."""
    top = entities(spark, d).filter("last_modified IS NOT NULL").orderBy(F.desc("last_modified"), "id").limit(50)
    rows = top.select("name", F.coalesce("source_url", F.lit("")).alias("url"), F.col("last_modified").cast("timestamp").alias("at"))
    return sinks.rss_items(rows, "name", "url", "at")


@register("sink_articles", given("a AS (SELECT slug, id, score, 'first' AS run, 0 AS ord FROM ent WHERE k % 3 < 2 UNION ALL SELECT slug, id, score + 1, 'second', 1 FROM ent WHERE k % 3 > 0) SELECT slug, arg_max(id, (ord, score, id)) AS id, arg_max(run, (ord, score, id)) AS run FROM a GROUP BY slug", ENT))
def sink_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles replaced by slug, the last run and the best row winning."""
    e = entities(spark, d)
    first = e.filter("k % 3 < 2").select("slug", "id", "score", F.lit("first").alias("run"), F.lit(0).alias("ord"))
    second = e.filter("k % 3 > 0").select("slug", "id", (F.col("score") + 1).alias("score"), F.lit("second").alias("run"), F.lit(1).alias("ord"))
    return M.first_by(first.unionByName(second), ["slug"], [F.desc("ord"), F.desc("score"), F.desc("id")]).select("slug", "id", "run")


@register("sink_cold_hot", "SELECT CASE WHEN doc_id % 5 = 2 THEN 'paper' ELSE 'other' END AS type, count(*) AS rows, count(CASE WHEN doc_id % 5 <> 2 AND coalesce(length(text), 0) > 0 THEN 1 END) AS bodies, CAST(coalesce(sum(CASE WHEN doc_id % 5 <> 2 THEN least(length(text), 2048) END), 0) AS BIGINT) AS chars FROM documents GROUP BY 1")
def sink_cold_hot(spark: SparkSession, d: str) -> DataFrame:
    """Bodies written apart from the slim rows, none of papers, 2048 characters of others; here joined again."""
    path = sinks.scratch(spark, "split")
    docs = read(spark, d, "documents").withColumn("type", F.when(F.col("doc_id") % 5 == 2, "paper").otherwise("other"))
    docs.select("doc_id", "type").write.mode("overwrite").parquet(f"{path}/hot")
    cold = docs.filter("type <> 'paper'").select("doc_id", F.substring("text", 1, 2048).alias("body")).filter(F.length("body") > 0)
    cold.write.mode("overwrite").parquet(f"{path}/cold")
    both = spark.read.parquet(f"{path}/hot").join(spark.read.parquet(f"{path}/cold"), "doc_id", "left")
    return both.groupBy("type").agg(F.count("*").alias("rows"), F.count("body").alias("bodies"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"))


@register("sink_round_robin", given("SELECT CAST(rn % 20 AS BIGINT) AS shard, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS rn FROM ent) GROUP BY 1", ENT))
def sink_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to twenty shards in turn."""
    rows = sinks.numbered(entities(spark, d).select("id"), [F.asc("id")])
    return rows.groupBy((F.col("row") % 20).alias("shard")).agg(F.count("*").alias("n"))


@register("sort_dimensions", given("x AS (SELECT id, 'downloads' AS sort, row_number() OVER (ORDER BY downloads DESC NULLS LAST, score DESC, id) AS rn FROM ent UNION ALL SELECT id, 'newest', row_number() OVER (ORDER BY last_modified DESC NULLS LAST, score DESC, id) FROM ent UNION ALL SELECT id, 'authority', row_number() OVER (ORDER BY mesh_points DESC NULLS LAST, score DESC, id) FROM ent) SELECT * FROM x WHERE rn <= 40", ENT))
def sort_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """The first forty by several dimensions, each with the same rest of the order."""
    out = None
    for name, column in (("downloads", "downloads"), ("newest", "last_modified"), ("authority", "mesh_points")):
        order = [F.desc_nulls_last(column), F.desc("score"), F.asc("id")]
        top = entities(spark, d).select("id", "score", column).orderBy(*order).limit(40)
        part = sinks.numbered(top, order).select("id", F.lit(name).alias("sort"), (F.col("row") + 1).alias("rn"))
        out = part if out is None else out.unionByName(part)
    return out


@register("sort_external", "SELECT doc_id, CAST(row_number() OVER (ORDER BY length(text) DESC NULLS LAST, doc_id) - 1 AS BIGINT) AS row FROM documents")
def sort_external(spark: SparkSession, d: str) -> DataFrame:
    """All rows numbered in an order that no task sees whole."""
    docs = read(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return sinks.numbered(docs, [F.desc_nulls_last("n"), F.asc("doc_id")]).select("doc_id", "row")


@register("queue_refresh", given("q AS (SELECT id, substr(sha256(id), 1, 16) AS umid, score, last_seen FROM ent WHERE has_gguf = false) SELECT * FROM (SELECT id, 'best' AS queue FROM q WHERE umid >= '00' AND umid < '80g' ORDER BY score DESC, id LIMIT 30) UNION ALL SELECT * FROM (SELECT id, 'stale' FROM q ORDER BY last_seen NULLS FIRST, id LIMIT 30)", ENT))
def queue_refresh(spark: SparkSession, d: str) -> DataFrame:
    """What to refresh next: the best in a range of digests, and the longest unseen."""
    q = entities(spark, d).filter("NOT has_gguf").select("id", F.substring(F.sha2("id", 256), 1, 16).alias("umid"), "score", "last_seen")
    best = q.filter("umid >= '00' AND umid < '80g'").orderBy(F.desc("score"), "id").limit(30).select("id", F.lit("best").alias("queue"))
    return best.unionByName(q.orderBy(F.asc_nulls_first("last_seen"), "id").limit(30).select("id", F.lit("stale").alias("queue")))


@register("queue_images", given("SELECT id, source_url FROM ent WHERE source_url LIKE 'http%' AND NOT contains(source_url, 'host1') ORDER BY score DESC, id LIMIT 25", ENT))
def queue_images(spark: SparkSession, d: str) -> DataFrame:
    """The best entities whose pictures are elsewhere."""
    far = F.col("source_url").startswith("http") & ~F.contains("source_url", F.lit("host1"))
    return entities(spark, d).filter(far).orderBy(F.desc("score"), "id").limit(25).select("id", "source_url")


@register("stats_articles", given("r AS (SELECT unnest(tags) AS slug, id FROM ent), c AS (SELECT slug, count(*) AS refs FROM r GROUP BY slug), a AS (SELECT DISTINCT unnest(tags) AS slug FROM ent UNION SELECT 'never-used') SELECT a.slug, coalesce(refs, 0) AS refs, least(20 + coalesce(refs, 0), 50) AS score FROM a LEFT JOIN c USING (slug)", ENT))
def stats_articles(spark: SparkSession, d: str) -> DataFrame:
    """References to each article, and its score of 20 and one for each, up to 50."""
    refs = entities(spark, d).select(F.explode("tags").alias("slug")).groupBy("slug").agg(F.count("*").alias("refs"))
    articles = entities(spark, d).select(F.explode("tags").alias("slug")).unionByName(spark.createDataFrame([("never-used",)], "slug string")).distinct()
    return articles.join(refs, "slug", "left").select("slug", F.coalesce("refs", F.lit(0)).alias("refs"), F.least(20 + F.coalesce("refs", F.lit(0)), F.lit(50)).alias("score"))


@register("stats_fresh", given("SELECT source, max(last_modified) AS latest, date_diff('day', max(last_modified), DATE '2024-02-01') > 7 AS stale, count(*) < CASE source WHEN 'arxiv' THEN 100 WHEN 'github' THEN 10 ELSE 50 END AS below_floor FROM ent GROUP BY source", ENT))
def stats_fresh(spark: SparkSession, d: str) -> DataFrame:
    """F17, freshness threshold: sources whose newest row is over a week old, and those that gave fewer rows than their floor."""
    floors = spark.createDataFrame([("arxiv", 100), ("github", 10), ("huggingface", 50)], "source string, least long")
    got = entities(spark, d).groupBy("source").agg(F.max("last_modified").alias("latest"), F.count("*").alias("n"))
    late = F.datediff(F.lit("2024-02-01").cast("date"), "latest") > 7
    return got.join(floors, "source", "left").select("source", "latest", late.alias("stale"), (F.col("n") < F.col("least")).alias("below_floor"))


@register("rank_last_per_source", given("SELECT source, arg_max(id, (last_seen, id)) AS id, max(last_seen) AS last_seen FROM ent WHERE last_seen IS NOT NULL GROUP BY source", ENT))
def rank_last_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each source."""
    top = R.top_n(entities(spark, d).filter("last_seen IS NOT NULL"), ["source"], [F.desc("last_seen"), F.desc("id")], 1)
    return top.select("source", "id", "last_seen")
