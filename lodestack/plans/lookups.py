"""Queries: look-ups by several keys, folds, groups of one model on several platforms, term links and the serving verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import api
from lodestack.operators import filters as Q
from lodestack.operators import graph as G
from lodestack.operators import lookups as K
from lodestack.operators import merge as M
from lodestack.operators import search as S
from lodestack.plans.duck import ENT, HIST, REL, given, stems, words
from lodestack.plans.registry import register
from lodestack.plans.texts import CENTRES
from lodestack.sources import sinks
from lodestack.sources.catalogue import entities, history, read, relations


@register("join_hosted_on", given("""h AS (SELECT CASE k % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS p, CASE WHEN k % 2 = 0 THEN upper(replace(slug, '--', '/')) ELSE slug END AS m FROM ent WHERE k % 7 = 0 UNION ALL SELECT 'delta', coalesce(author, 'x') || '/' || name FROM ent WHERE k % 11 = 0),
 l AS (SELECT DISTINCT p, unnest([lower(trim(m)), regexp_replace(lower(trim(m)), '^([^/]*)/', '\\1--'), regexp_replace(lower(trim(m)), '^(.*?)--', '\\1/')]) AS key FROM h),
 t AS (SELECT id, unnest(ks) AS key, unnest(range(len(ks))) AS pos FROM (SELECT id, [regexp_replace(lower(id), '^[a-z]+-[a-z]+--', ''), lower(id), lower(slug), lower(slug), lower(author || '/' || name), lower(author || '/' || name)] AS ks FROM ent)),
 j AS (SELECT t.id, t.pos, string_agg(DISTINCT l.p, ',' ORDER BY l.p) AS hosts FROM t JOIN l ON l.key = t.key GROUP BY t.id, t.pos) SELECT id, arg_min(hosts, pos) AS hosted_on FROM j GROUP BY id""", ENT))
def join_hosted_on(spark: SparkSession, d: str) -> DataFrame:
    """Providers of each entity, by the first of its keys that one has."""
    e, k = entities(spark, d), F.col("k")
    one = e.filter("k % 7 = 0").select(F.when(k % 3 == 0, "alpha").when(k % 3 == 1, "beta").otherwise("gamma").alias("provider"), F.when(k % 2 == 0, F.upper(F.replace("slug", F.lit("--"), F.lit("/")))).otherwise(F.col("slug")).alias("model"))
    two = e.filter("k % 11 = 0").select(F.lit("delta").alias("provider"), F.concat(F.coalesce("author", F.lit("x")), F.lit("/"), "name").alias("model"))
    return K.hosted_on(e, one.unionByName(two)).select("id", F.array_join("hosted_on", ",").alias("hosted_on"))


@register("join_backfill", given("""c AS (SELECT key, max(v) AS v FROM (SELECT name AS key, score AS v FROM ent WHERE k % 5 = 0 UNION ALL SELECT author || '/' || name, score + 1 FROM ent WHERE k % 3 = 0 UNION ALL SELECT id, score + 2 FROM ent WHERE k % 2 = 0) WHERE key IS NOT NULL GROUP BY key)
 SELECT e.id, coalesce(e.params_billions, a.v, b.v, i.v) AS params FROM ent e LEFT JOIN c a ON a.key = e.name LEFT JOIN c b ON b.key = e.author || '/' || e.name LEFT JOIN c i ON i.key = e.id""", ENT))
def join_backfill(spark: SparkSession, d: str) -> DataFrame:
    """A missing fact from a cache, by name, author and name, or id."""
    e = entities(spark, d)
    full = F.concat("author", F.lit("/"), "name")
    known = e.filter("k % 5 = 0").select(F.col("name").alias("key"), F.col("score").alias("v")).unionByName(e.filter("k % 3 = 0").select(full.alias("key"), (F.col("score") + 1).alias("v"))).unionByName(e.filter("k % 2 = 0").select(F.col("id").alias("key"), (F.col("score") + 2).alias("v")))
    best = known.filter("key IS NOT NULL").groupBy("key").agg(F.max("v").alias("v"))
    found = K.first_known(e, "id", [F.col("name"), full, F.col("id")], best, "key", "v")
    return e.join(found, "id", "left").select("id", F.coalesce("params_billions", "v").alias("params"))


@register("join_profiles", given("p AS (SELECT CASE k % 3 WHEN 0 THEN id WHEN 1 THEN upper(id) ELSE lower(id) END AS id, k AS v FROM ent WHERE k % 4 > 0) SELECT e.id, coalesce(a.v, b.v) AS v FROM (SELECT id, CASE WHEN k % 5 = 0 THEN upper(id) ELSE id END AS asked FROM ent) e LEFT JOIN (SELECT id, min(v) AS v FROM p GROUP BY id) a ON a.id = e.asked LEFT JOIN (SELECT lower(id) AS id, min(v) AS v FROM p GROUP BY 1) b ON b.id = lower(e.asked)", ENT))
def join_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by id as it is, then in lower case."""
    e, k = entities(spark, d), F.col("k")
    p = e.filter("k % 4 > 0").select(F.when(k % 3 == 0, F.col("id")).when(k % 3 == 1, F.upper("id")).otherwise(F.lower("id")).alias("key"), k.alias("v"))
    exact = p.groupBy("key").agg(F.min("v").alias("v"))
    asked = e.select("id", F.when(k % 5 == 0, F.upper("id")).otherwise(F.col("id")).alias("asked"))
    low = p.groupBy(F.lower("key").alias("low")).agg(F.min("v").alias("w"))
    both = asked.join(exact, asked["asked"] == exact["key"], "left").join(low, F.lower("asked") == F.col("low"), "left")
    return both.select("id", F.coalesce("v", "w").alias("v"))


@register("join_top_vectors", given("t AS (SELECT * FROM ent ORDER BY score DESC, coalesce(likes, 0) DESC, slug, id LIMIT 120) SELECT t.id, t.score, round(CAST(v.embedding[1] AS DOUBLE), 6) AS first, len(v.embedding) AS dim FROM t LEFT JOIN embeddings v ON v.vec_id = t.k", ENT))
def join_top_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The best entities in one order over all, with their vectors."""
    top = entities(spark, d).orderBy(F.desc("score"), F.coalesce("likes", F.lit(0)).desc(), "slug", "id").limit(120)
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    return top.join(v, "k", "left").select("id", "score", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@register("join_demos", given("s AS (SELECT id, source_url AS url, CASE WHEN k % 2 = 0 THEN 'gradio' ELSE 'docker' END AS sdk, coalesce(likes, 0) AS likes, slug FROM ent WHERE type = 'space' AND source_url IS NOT NULL), u AS (SELECT s.*, m.id AS model FROM s JOIN ent m ON m.type = 'model' AND m.slug = s.slug) SELECT m.id, b.url AS demo_url, b.sdk AS demo_sdk FROM ent m LEFT JOIN (SELECT model, arg_max(url, (likes, -rank_)) AS url, arg_max(sdk, (likes, -rank_)) AS sdk FROM (SELECT *, row_number() OVER (ORDER BY id) AS rank_ FROM u) GROUP BY model) b ON b.model = m.id WHERE m.type = 'model'", ENT))
def join_demos(spark: SparkSession, d: str) -> DataFrame:
    """The most liked space that uses a model, folded onto it."""
    e = entities(spark, d)
    models = e.filter("type = 'model'").select("id", "slug")
    spaces = e.filter("type = 'space'").select("id", "slug", F.col("source_url").alias("url"), F.when(F.col("k") % 2 == 0, "gradio").otherwise("docker").alias("sdk"), "likes")
    uses = spaces.select(F.col("id").alias("space"), "slug").join(models.select(F.col("id").alias("model"), "slug"), "slug").select("space", "model")
    return K.fold_demos(models.select("id"), spaces, uses).select("id", "demo_url", "demo_sdk")


@register("join_fulltexts", given("q AS (SELECT id, '2401.' || lpad(CAST(k AS VARCHAR), 5, '0') AS paper FROM ent WHERE type = 'paper'), s AS (SELECT '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS paper, length(text) AS n FROM documents WHERE length(text) >= 200) SELECT paper, id, n FROM q JOIN s USING (paper)", ENT))
def join_fulltexts(spark: SparkSession, d: str) -> DataFrame:
    """Pending papers and the long texts that an outer corpus has of each; numbers of over five digits are cut, so a paper may have several."""
    number = lambda c: F.concat(F.lit("2401."), F.lpad(F.col(c).cast("string"), 5, "0"))
    pending = entities(spark, d).filter("type = 'paper'").select("id", number("k").alias("paper"))
    corpus = read(spark, d, "documents").select(number("doc_id").alias("paper"), "text")
    return K.drain(pending, corpus, "paper", 200).withColumn("n", F.col("n").cast("long"))


_NORM = "regexp_replace(lower(CASE WHEN k % 2 = 0 THEN slug ELSE slug || '-gguf' END), '[^a-z0-9]+', '-', 'g')"


@register("match_platforms", given(f"""m AS (SELECT id, k, {_NORM} AS norm, author, params_billions AS p, CASE k % 10 WHEN 0 THEN 'llama' ELSE '' END AS arch, downloads, slug FROM ent WHERE type = 'model'),
 s AS (SELECT x.id AS a, y.id AS b, CASE WHEN x.arch <> '' AND y.arch <> '' AND x.arch <> y.arch OR coalesce(x.p <> 0 AND y.p <> 0 AND abs(x.p - y.p) > 0.1, false) THEN 0E0 WHEN x.norm = y.norm THEN 1E0 WHEN contains(x.norm, y.norm) OR contains(y.norm, x.norm) THEN CASE WHEN x.author = y.author THEN 0.95E0 ELSE 0.8E0 END ELSE 0E0 END AS s FROM m x JOIN m y ON x.slug = y.slug AND x.id < y.id) SELECT a, b, s FROM s WHERE s >= 0.7E0""", ENT))
def match_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Records of one model on several platforms: of one slug, scored; sizes that differ rule a pair out."""
    from lodestack.operators.matching import meet

    k = F.col("k")
    norm = F.regexp_replace(F.lower(F.when(k % 2 == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-gguf")))), "[^a-z0-9]+", "-")
    m = entities(spark, d).filter("type = 'model'").select("id", norm.alias("norm"), "author", "params_billions", F.when(k % 10 == 0, "llama").otherwise("").alias("architecture"), "slug")
    pairs = meet(m, m, "slug", "id", "id").filter(F.col("x.id") < F.col("y.id"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), K.group_scores("x", "y").alias("s")).filter("s >= 0.7")


@register("match_groups")
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records of one model, as a greedy pass by id gives them; iterative, so compared with such a pass in the tests."""
    from lodestack.operators.groups import platform_groups

    k = F.col("k")
    norm = F.concat_ws("/", F.lower("author"), F.regexp_replace(F.lower(F.when(k % 3 == 0, F.concat(F.substring_index("slug", "--", -1), F.lit("-chat"))).otherwise(F.substring_index("slug", "--", -1))), "[^a-z0-9]+", "-"))
    m = entities(spark, d).filter("type = 'model'").select("id", norm.alias("norm"), F.col("author"), F.when(k % 4 > 0, F.col("params_billions")).alias("params_billions"), F.when(k % 10 == 0, "llama").otherwise("").alias("architecture"))
    return platform_groups(m)


@register("match_canonical", given(f"""m AS (SELECT id, {_NORM} AS norm, downloads, source, slug FROM ent WHERE type = 'model') SELECT slug, arg_max(id, (coalesce(downloads, 0), source = 'huggingface', -rk)) AS canonical, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY id) AS rk FROM m) GROUP BY slug HAVING count(*) > 1""", ENT))
def match_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical record of each group: most downloads, then the main hub, then the first id."""
    m = entities(spark, d).filter("type = 'model'")
    best = M.first_by(m, ["slug"], [F.coalesce("downloads", F.lit(0)).desc(), (F.col("source") == "huggingface").desc(), F.asc("id")])
    return best.select("slug", F.col("id").alias("canonical")).join(m.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1"), "slug")


@register("merge_scrubbed", given("""s AS (SELECT k, 'hf-model--' || slug AS id, CASE WHEN k % 4 > 0 THEN name END AS name, CASE WHEN k % 3 = 1 THEN license END AS license, score, likes, tags FROM ent WHERE type = 'model'), t AS (SELECT id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT id, unnest(tags) AS tag FROM s) GROUP BY id)
 SELECT s.id, count(*) AS folded, arg_max(name, k) AS name, arg_max(license, k) AS license, max(score) AS score, max(likes) AS likes, any_value(t.tags) AS tags FROM s JOIN t USING (id) GROUP BY s.id""", ENT))
def merge_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """M3: ids normalised anew, then records of one id folded by the rules of a merge."""
    from lodestack.functions.identity import canonical

    k = F.col("k")
    e = entities(spark, d).filter("type = 'model'")
    raw = F.when(k % 3 == 0, F.replace("slug", F.lit("--"), F.lit("/"))).otherwise(F.col("slug"))
    ids = e.select("k", canonical(raw, F.lit("huggingface"), F.lit("model")).alias("id"), F.when(k % 4 > 0, F.col("name")).alias("name"), F.when(k % 3 == 1, F.col("license")).alias("license"), "score", "likes", "tags")
    return M.fold(ids, "id", k, greatest=["score", "likes"], union=["tags"]).drop("k").withColumn("tags", F.array_join("tags", ","))


@register("join_fulltexts_files", given("q AS (SELECT id, '2401.' || lpad(CAST(k AS VARCHAR), 5, '0') AS paper FROM ent WHERE type = 'paper'), s AS (SELECT '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS paper, min(struct_pack(file := CAST(doc_id % 64 AS INTEGER), doc := doc_id, n := CAST(length(text) AS INTEGER))) AS b FROM documents WHERE length(text) >= 200 GROUP BY 1) SELECT paper, id, b.file AS file, b.n AS n, CASE WHEN b.file < 8 THEN 0 WHEN b.file < 24 THEN 1 WHEN b.file < 56 THEN 2 ELSE 3 END AS batch FROM q JOIN s USING (paper)", ENT))
def join_fulltexts_files(spark: SparkSession, d: str) -> DataFrame:
    """As join_fulltexts, from a corpus of numbered files that are read in batches until nothing is pending."""
    path = sinks.scratch(spark, "corpus")
    number = lambda c: F.concat(F.lit("2401."), F.lpad(F.col(c).cast("string"), 5, "0"))
    corpus = read(spark, d, "documents").select(number("doc_id").alias("paper"), "text", F.col("doc_id").alias("at"), (F.col("doc_id") % 64).cast("int").alias("file"))
    corpus.repartition("file").write.partitionBy("file").parquet(f"{path}/files")
    pending = entities(spark, d).filter("type = 'paper'").select("id", number("k").alias("paper"))
    return K.drain_files(spark, pending, f"{path}/files", "paper", 200, path)[0]


@register("join_around", given("""a AS (SELECT 'hf-model--' || CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, verb AS type, conf / 100E0 AS conf, 0 AS source FROM rel),
 b AS (SELECT CAST(src AS VARCHAR), 'HF-Dataset--' || CAST(dst AS VARCHAR), '', CASE WHEN conf % 3 > 0 THEN conf / 50E0 END, 1 FROM rel WHERE conf % 2 = 0),
 c AS (SELECT id, 'report--' || CAST(k % 10 AS VARCHAR), 'FEATURED_IN', 1E0, 2 FROM ent), e AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
 n AS (SELECT *, regexp_replace(lower(src), '^(hf-model|hf-dataset|arxiv-paper|gh-tool|hf-space|report)--', '') AS s, regexp_replace(lower(dst), '^(hf-model|hf-dataset|arxiv-paper|gh-tool|hf-space|report)--', '') AS t FROM (SELECT src, dst, coalesce(nullif(type, ''), 'RELATED') AS type, coalesce(nullif(conf, 0), 0.8E0) AS conf, source FROM e)),
 u AS (SELECT s AS node, dst AS other, t AS o, type, conf, source FROM n WHERE s <> t UNION ALL SELECT t, src, s, type, conf, source FROM n WHERE s <> t)
 SELECT CAST(node AS BIGINT) AS node, other, type, round(conf, 6) AS conf, source FROM u JOIN (SELECT DISTINCT src AS q FROM rel WHERE src % 50 = 0) ON node = CAST(q AS VARCHAR) QUALIFY row_number() OVER (PARTITION BY node, o, type ORDER BY source, conf DESC, other) = 1""", ENT, REL))
def join_around(spark: SparkSession, d: str) -> DataFrame:
    """Relations of several sources around every entity whose number is divisible by 50, from either end, the first source first."""
    r = relations(spark, d)
    text = lambda c: F.col(c).cast("string")
    graph = r.select(F.concat(F.lit("hf-model--"), text("src")).alias("src"), text("dst").alias("dst"), F.col("verb").alias("type"), (F.col("conf") / 100.0).alias("conf"))
    stated = r.filter("conf % 2 = 0").select(text("src").alias("src"), F.concat(F.lit("HF-Dataset--"), text("dst")).alias("dst"), F.lit("").alias("type"), F.when(F.col("conf") % 3 > 0, F.col("conf") / 50.0).alias("conf"))
    reports = entities(spark, d).select(F.col("id").alias("src"), F.concat(F.lit("report--"), (F.col("k") % 10).cast("string")).alias("dst"), F.lit("FEATURED_IN").alias("type"), F.lit(1.0).alias("conf"))
    nodes = r.filter("src % 50 = 0").select(text("src").alias("node")).distinct()
    found = K.around(nodes, [graph, stated, reports])
    return found.select(F.col("node").cast("long").alias("node"), "other", "type", F.round("conf", 6).alias("conf"), "source")


@register("filter_harvest_urls", given("SELECT id FROM ent WHERE length(source_url) >= 8 AND source_url <> CASE WHEN id LIKE 'gh-%' AND author IS NOT NULL THEN 'https://github.com/' || author || '/' || name ELSE '' END AND k % 3 > 0 UNION ALL SELECT id FROM ent WHERE k % 3 = 0 AND NOT (id LIKE 'gh-%' AND author IS NOT NULL)", ENT))
def filter_harvest_urls(spark: SparkSession, d: str) -> DataFrame:
    """addresses that a harvest gave: long enough, and not merely what follows from the id."""
    from lodestack.functions.metadata import source_url

    derived = source_url(F.col("id"), F.col("author"), F.col("name"))
    gh = F.col("id").startswith("gh-") & F.col("author").isNotNull()
    url = F.when(F.col("k") % 3 == 0, F.when(gh, derived).otherwise("https://other.example.org")).otherwise(F.col("source_url"))
    return entities(spark, d).withColumns({"url": url, "derived": derived}).filter(Q.harvested("url", "derived")).select("id")


@register("filter_stubs", given("t AS (SELECT id, k, CASE k % 5 WHEN 0 THEN 'knowledge--' || slug WHEN 1 THEN 'concept--' || slug WHEN 2 THEN id ELSE 'hf-model--' || slug END AS dst FROM ent) SELECT id, dst FROM t WHERE k % 5 > 1 AND dst IN (SELECT id FROM ent UNION SELECT 'hf-model--' || slug FROM ent WHERE k % 2 = 0)", ENT))
def filter_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Edges to concepts, which are stubs, go, and those whose target isn't known; the rest stay."""
    e, k = entities(spark, d), F.col("k")
    dst = F.when(k % 5 == 0, F.concat(F.lit("knowledge--"), "slug")).when(k % 5 == 1, F.concat(F.lit("concept--"), "slug")).when(k % 5 == 2, F.col("id")).otherwise(F.concat(F.lit("hf-model--"), "slug"))
    known = e.select(F.col("id").alias("dst")).unionByName(e.filter("k % 2 = 0").select(F.concat(F.lit("hf-model--"), "slug").alias("dst"))).distinct()
    return e.select("id", dst.alias("dst")).filter(~Q.concept_stub("dst")).join(known, "dst", "left_semi").select("id", "dst")


# A registry of the fixed terms, and after them of the words of names and texts, which are terms of their own.
_FIXED_TERMS = ", ".join(f"({k}, '{t}', [{', '.join(repr(a) for a in aliases)}])" for k, (t, aliases) in enumerate(G.TERMS.items()))
_TERMS = f"""fixed AS (SELECT * FROM (VALUES {_FIXED_TERMS}) v(pos, term, aliases)), own AS (SELECT DISTINCT unnest(string_split_regex(lower(name), '\\s+')) AS w FROM ent UNION SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) FROM documents),
 terms AS (SELECT * FROM fixed UNION ALL SELECT 100, 'word ' || w, [w] FROM own WHERE length(w) > 3)"""


@register("graph_term_links", given(f"""{_TERMS}, t AS (SELECT id, lower(name || ' ' || array_to_string(tags, ' ')) AS x FROM ent), a AS (SELECT pos, term, unnest(aliases) AS alias, unnest(range(len(aliases))) AS nth FROM terms),
 f AS (SELECT id, pos, term, arg_min(alias, nth) AS alias, any_value(x) AS x FROM t JOIN a ON contains(x, lower(alias)) GROUP BY id, pos, term), n AS (SELECT count(*) AS n FROM t), df AS (SELECT pos, term, count(*) AS df FROM f GROUP BY pos, term),
 s AS (SELECT id, pos, term, alias, len(list_filter(string_split_regex(x, '\\s+'), lambda w: contains(w, lower(alias)))) / CAST(greatest(1, len(string_split_regex(x, '\\s+'))) AS DOUBLE) * ln(n / CAST(greatest(1, df) AS DOUBLE)) AS score FROM f JOIN df USING (pos, term), n)
 SELECT id, term, alias, round(score, 3) AS score FROM s WHERE score >= 0.4E0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, term) <= 20""", ENT))
def graph_term_links(spark: SparkSession, d: str) -> DataFrame:
    """Links from entities to the terms that their texts speak of, by frequency and rarity, from 0.4 on; the first twenty an entity.
    The registry has the fixed terms and thousands of words."""
    e = entities(spark, d)
    fixed = spark.createDataFrame([(k, t, a) for k, (t, a) in enumerate(G.TERMS.items())], "at int, term string, aliases array<string>")
    split = lambda df, column, pattern: df.select(F.explode(F.split(F.lower(column), pattern)).alias("w"))
    own = split(e, "name", r"\s+").unionByName(split(read(spark, d, "documents"), "text", "[^a-z]+")).filter(F.length("w") > 3).distinct()
    terms = fixed.unionByName(own.select(F.lit(100).alias("at"), F.concat(F.lit("word "), "w").alias("term"), F.array("w").alias("aliases")))
    return G.term_links(e, "id", F.concat_ws(" ", "name", F.array_join("tags", " ")), terms)


@register("search_fallback", given("SELECT id, score, score AS relevance FROM ent WHERE type = 'tool' ORDER BY score DESC, id LIMIT 20", ENT))
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A query none of whose words counts, or is known, is answered by browsing."""
    return api.Catalogue(entities(spark, d)).search("the of zzzqqq", type="tool", limit=20).select("id", "score", "relevance")


@register("search_clustered", given(f"{CENTRES}, members AS (SELECT v.vec_id, v.label, ent.score FROM embeddings v JOIN ent ON ent.k = v.vec_id), best AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 200) SELECT query, vec_id, round(0.35E0 * least(99.9E0, sim * 100) + 0.65E0 * score, 4) AS relevance FROM near JOIN best USING (label) QUALIFY row_number() OVER (PARTITION BY query ORDER BY relevance DESC, vec_id) <= 30", ENT))
def search_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The best entities of the clusters nearest each query, scored anew with the nearness of their cluster in the place of the semantic factor."""
    from pyspark.sql import Window

    e = read(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding")
    members = e.select("vec_id", "label").join(entities(spark, d).select(F.col("k").alias("vec_id"), "score"), "vec_id")
    found = S.cluster_candidates(members, "vec_id", "label", S.centroids(e, "embedding", "label"), asked, "embedding", "score")
    rows = found.select("query", "vec_id", F.round(0.35 * F.least(F.lit(99.9), F.col("sim") * 100) + 0.65 * F.col("score"), 4).alias("relevance"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "vec_id"))).filter("rn <= 30").drop("rn")


# Verbs ------------------------------------------------------------------------------------------------------------------------


_RANKED = stems(words("'summarization chat models with adapters'"))


@register("verb_rank", given(f"p AS (SELECT id, score, unnest({stems(words("concat_ws(' ', name, slug, author, description)"))}) AS term FROM ent), tot AS (SELECT count(DISTINCT id) AS n, count(*) / CAST(count(DISTINCT id) AS DOUBLE) AS avg_len FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT {_RANKED} AS w), h AS (SELECT id, sum(x) * count(*) / (SELECT len(w) FROM q) AS relevance FROM (SELECT p.id, floor((floor(score + 0.5) * 0.6E0 + ln((n - df + 0.5E0) / (df + 0.5E0) + 1) * 2.2E0 / (1 + 1.2E0 * (0.25E0 + 0.75E0 / avg_len)) * 16) * 100 + 0.5) / 100 AS x FROM p JOIN df USING (term), tot, q WHERE list_contains(w, p.term)) GROUP BY id) SELECT id, round(relevance, 6) AS relevance, score FROM h JOIN ent USING (id) ORDER BY round(relevance, 9) DESC, score DESC, id LIMIT 20", ENT))
def verb_rank(spark: SparkSession, d: str) -> DataFrame:
    """rank: the best entities for a task and words."""
    return api.Catalogue(entities(spark, d)).rank("summarization", "chat models with adapters").select("id", F.round("relevance", 6).alias("relevance"), "score")


@register("verb_entity", given("r AS (SELECT unnest(['hf-dataset--brand5--small-widget-1', 'brand2--blue-rod', 'gone--for-good']) AS req, unnest(range(3)) AS pos) SELECT pos, req, CASE WHEN count(e.id) = 0 THEN 404 WHEN max(CASE WHEN e.id = r.req THEN 1 ELSE 0 END) = 1 OR count(e.id) = 1 THEN 200 ELSE 409 END AS status, coalesce(max(CASE WHEN e.id = r.req THEN e.id END), CASE WHEN count(e.id) = 1 THEN min(e.id) END) AS id FROM r LEFT JOIN ent e ON e.id = r.req OR e.slug = r.req GROUP BY pos, req", ENT))
def verb_entity(spark: SparkSession, d: str) -> DataFrame:
    """entity: one id or slug: found, absent or ambiguous, as an HTTP status."""
    cat, out = api.Catalogue(entities(spark, d)), None
    for pos, req in enumerate(["hf-dataset--brand5--small-widget-1", "brand2--blue-rod", "gone--for-good"]):
        one = cat.lookup(req).select(F.lit(pos).cast("long").alias("pos"), "req", "status", "id")
        out = one if out is None else out.unionByName(one)
    return out


@register("verb_trends", given("w AS (SELECT unnest([1, 2, 3, 999999]) AS id), n AS (SELECT id, count(*) AS points FROM hist GROUP BY id) SELECT w.id, CASE WHEN n.points >= 2 THEN n.points END AS points, coalesce(n.points, 0) < 2 AS missing FROM w LEFT JOIN n USING (id)", HIST))
def verb_trends(spark: SparkSession, d: str) -> DataFrame:
    """trends/batch: trend rows of some ids, and which have none."""
    t = api.Catalogue(entities(spark, d), history(spark, d)).trends([1, 2, 3, 999999])
    return t.select("id", F.col("points").cast("long").alias("points"), F.col("points").isNull().alias("missing"))


@register("verb_concepts", given("c AS (SELECT id, name FROM ent WHERE primary_category = (SELECT min(primary_category) FROM ent)) SELECT id, name, (SELECT count(*) FROM c) AS total, CASE WHEN (SELECT count(*) FROM c) > 10 THEN 10 END AS next_offset FROM c ORDER BY id LIMIT 5 OFFSET 5", ENT))
def verb_concepts(spark: SparkSession, d: str) -> DataFrame:
    """concepts, L8: a page of a category, with the total and the next offset."""
    e = entities(spark, d)
    least = e.agg(F.min("primary_category").alias("c")).first()["c"]
    return api.Catalogue(e).concepts(least, limit=5, offset=5).select("id", "name", "total", F.col("next_offset").cast("long").alias("next_offset"))


@register("verb_badge", given("SELECT id, score, CASE WHEN score >= 90 THEN '#4c1' WHEN score >= 70 THEN '#08c' WHEN score >= 50 THEN '#dfb317' ELSE '#e05d44' END AS colour, CASE WHEN score >= 90 THEN 'High signal' WHEN score >= 70 THEN 'Medium signal' WHEN score >= 50 THEN 'Low signal' ELSE 'Insufficient signal' END AS label FROM ent WHERE k = 1", ENT))
def verb_badge(spark: SparkSession, d: str) -> DataFrame:
    """badge: colour and label of one entity."""
    e = entities(spark, d)
    return api.Catalogue(e).badge(e.filter("k = 1").first()["id"])


@register("verb_health", given("SELECT count(*) AS entities, count(DISTINCT type) AS types, max(last_modified) AS latest FROM ent", ENT))
def verb_health(spark: SparkSession, d: str) -> DataFrame:
    """health: what is there."""
    return api.Catalogue(entities(spark, d)).health()


@register("verb_datasets", given("SELECT 'entities' AS name, count(*) AS rows FROM ent WHERE score > 50 UNION ALL SELECT 'lite', count(*) FROM ent WHERE score > 90", ENT))
def verb_datasets(spark: SparkSession, d: str) -> DataFrame:
    """datasets: the exports that there are, with their rows."""
    path = sinks.scratch(spark, "exports")
    e = entities(spark, d).select("id", "score")
    sinks.write_epoch(e.filter("score > 50"), f"{path}/entities", "e1")
    sinks.write_epoch(e.filter("score > 90"), f"{path}/lite", "e1")
    return api.datasets(spark, path, ["entities", "lite"])
