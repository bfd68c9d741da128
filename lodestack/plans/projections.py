"""Queries: projections of raw records and of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import metadata as M
from lodestack.operators import projections as P
from lodestack.operators import rank as R
from lodestack.plans.duck import ENT, FULL, RAW, given
from lodestack.plans.registry import register
from lodestack.sources.catalogue import entities, full_records, raw_records

_TEXT = {c: f"coalesce({', '.join(names)}, '{default}')" for c, (names, default) in P.TEXTS.items()}
_NUM = {c: f"CAST(coalesce({', '.join(names)}, 0) AS DOUBLE)" for c, (names, _) in P.NUMBERS.items()}
_BODY = "coalesce(readme, body_content, '')"
_EXCERPT = f"left(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(left({_BODY}, 300), '[#*`]', '', 'g'), '<[^>]*>', ' ', 'g'), '<[^>]*$', ''), '>', ' '), '\\s+', ' ', 'g')), 250)"
_DESCRIPTION = f"CASE WHEN octet_length(encode(coalesce(description, summary, ''))) >= 5 THEN coalesce(description, summary, '') ELSE {_EXCERPT} END"
_STARS = "CAST(coalesce(stars, github_stars) AS DOUBLE)"
_SLIM = "id, " + ", ".join(f"{e} AS {c}" for c, e in (_TEXT | _NUM).items()) + f", {_DESCRIPTION} AS description, array_to_string(tags, ',') AS tags, {_STARS} AS stars"


@register("project_slim", given(f"SELECT {_SLIM} FROM raw", ENT, RAW))
def project_slim(spark: SparkSession, d: str) -> DataFrame:
    """The slim record, each column from the first of its aliases."""
    return P.slim(raw_records(spark, d)).withColumn("tags", F.array_join("tags", ","))


@register("project_relations", given(f"SELECT id, {_TEXT['slug']} AS slug, {_TEXT['type']} AS type, {_TEXT['name']} AS name, coalesce(description, '') AS description, {_NUM['fni_score']} AS fni_score, array_to_string(tags, ',') AS tags, velocity, source_url FROM raw", ENT, RAW))
def project_relations(spark: SparkSession, d: str) -> DataFrame:
    """The columns that relations are read from."""
    return P.for_relations(raw_records(spark, d)).withColumn("tags", F.array_join("tags", ","))


# The columns of the record that are kept as they are; those that the tables lack are left out.
_KEPT = ["body_content", "has_fulltext", "category", "summary", "params_billions", "architecture", "context_length", "is_trending", "trend_7d", "source_url", "image_url", "raw_image_url", "canonical_url", "vram_estimate_gb", "vram_fp16_gb", "vram_int8_gb", "vram_int4_gb", "task_categories", "num_rows", "primary_language", "forks", "citation_count", "runtime_hardware", "vocab_size", "num_layers", "hidden_size", "datasets_used", "quick_start", "has_ollama", "has_gguf", "hosted_on", "hosted_on_checked_at", "ui_related_mesh", "search_vector", "meta", "fni_metrics", "license_spdx", "source_platform", "benchmarks", "created_at", "readme", "base_model", "gguf_variants", "raw_pop", "num_heads", "kv_heads", "moe_experts", "moe_active", "sdk", "running_status", "size_category", "files_count", "modality", "published_year", "published_date"]


@register("project_fusion", given(f"SELECT {_SLIM}, {', '.join(_KEPT)} FROM full_records", ENT, RAW, FULL))
def project_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The slim record with all that later steps fall back on."""
    return P.for_merging(full_records(spark, d)).withColumn("tags", F.array_join("tags", ","))


@register("project_descriptions", given(f"SELECT id, {_DESCRIPTION} AS description FROM raw", ENT, RAW))
def project_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Description, summary, or an excerpt of the body."""
    raw = raw_records(spark, d)
    return raw.select("id", P.description(raw).alias("description"))


#: Columns of the record that artifacts keep, of those that a source has.
_ARTIFACT = ["id", "umid", "slug", "name", "type", "author", "description", "stars", "downloads", "likes", "citations", "fni_score", "fni_a", "primary_category", "pipeline_tag", "last_modified", "last_updated", "params_billions", "context_length", "has_gguf", "has_ollama", "license", "source"]


@register("project_artifacts", given(f"SELECT {', '.join(_ARTIFACT)} FROM raw WHERE k % 2 = 0", ENT, RAW))
def project_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """An artifact keeps some columns as they are; the scan reads what these need."""
    return raw_records(spark, d).filter("k % 2 = 0").select(*_ARTIFACT)


_OR = lambda *names, none="''": "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + f", {none})"
_MEASURED = lambda name: f"TRY_CAST(nullif(CAST({name} AS VARCHAR), '') AS DOUBLE) AS {name}"
_MIRROR = f"""id, {_OR("umid", "id")} AS umid, {_OR("name", "display_name")} AS name, {_OR("type", "entity_type", none="'model'")} AS type, {_OR("author")} AS author, {_OR("category")} AS category, array_to_string(tags, ', ') AS tags,
 coalesce(fni_score, fni, 0E0) AS fni_score, coalesce(fni_s, 50E0) AS fni_s, coalesce(fni_a, 0E0) AS fni_a, coalesce(fni_p, 0E0) AS fni_p, coalesce(fni_r, 0E0) AS fni_r, 0E0 AS fni_q,
 CAST(coalesce(downloads, 0) AS BIGINT) AS downloads, CAST(coalesce(stars, likes, 0) AS INTEGER) AS stars, coalesce(params_billions, 0E0) AS params_billions, CAST(coalesce(context_length, 0) AS BIGINT) AS context_length,
 {_OR("license", "license_spdx")} AS license, {_OR("pipeline_tag")} AS pipeline_tag, {_OR("source", "source_platform")} AS source, {_OR("primary_language")} AS primary_language, {_OR("last_modified")} AS last_modified, coalesce(is_trending, false) AS is_trending"""


@register("project_mirror_rows", given(f"SELECT {_MIRROR} FROM full_records", ENT, RAW, FULL))
def project_mirror_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the analytical mirror, all 23 columns."""
    return P.table_row(full_records(spark, d))


_LICENSED = "CASE WHEN coalesce(license, license_spdx, '') = '' THEN 'unknown' WHEN regexp_matches(lower(coalesce(license, license_spdx)), 'mit|apache-2.0|bsd-2-clause|bsd-3-clause|isc|unlicense|cc0-1.0|wtfpl|zlib|bsl-1.0|openrail') THEN 'permissive' WHEN regexp_matches(lower(coalesce(license, license_spdx)), 'gpl-2.0|gpl-3.0|lgpl-2.1|mpl-2.0') THEN 'copyleft' WHEN regexp_matches(lower(coalesce(license, license_spdx)), 'cc-by-nc|llama2|llama 2') THEN 'non-commercial' ELSE 'unknown' END"
_FACTOR = lambda f, own: f"coalesce({own}, TRY_CAST(json_extract_string(fni_metrics, '$.{f}') AS DOUBLE), 0E0) AS fni_{f}"
_TITLE = "coalesce(name, title, display_name)"
_YEAR = "coalesce(published_year, year(TRY_CAST(coalesce(json_extract_string(meta, '$.published_date'), published_date) AS DATE)))"
_CITED = f"CASE WHEN {_TITLE} NOT IN (id, slug, coalesce(umid, '')) THEN left('@misc{{' || left(regexp_replace(id, '[^a-zA-Z0-9]', '_', 'g'), 40) || ',title={{' || {_TITLE} || '}}' || coalesce(',author={{' || author || '}}', '') || CASE WHEN {_YEAR} > 1990 AND {_YEAR} < 2100 THEN ',year={{' || CAST({_YEAR} AS VARCHAR) || '}}' ELSE '' END || CASE WHEN NOT contains(source_url, 'host1.') THEN ',url={{' || source_url || '}}' ELSE '' END || ',note={{Indexed}}}}', 500) END"
_SERVED = f"""id, {_OR("umid", "id")} AS umid, {_OR("slug")} AS slug, {_OR("name", "display_name")} AS name, {_OR("type", none="'model'")} AS type, {_OR("author")} AS author, {_DESCRIPTION} AS summary, {_OR("category", "primary_category")} AS category, left(array_to_string(tags, ', '), 500) AS tags,
 coalesce(fni_score, 0E0) AS fni_score, {_OR("fni_percentile")} AS fni_percentile, {_FACTOR("s", "fni_s")}, {_FACTOR("a", "fni_a")}, {_FACTOR("p", "fni_p")}, {_FACTOR("r", "fni_r")}, {_FACTOR("q", "NULL")}, CAST(coalesce(raw_pop, 0) AS DOUBLE) AS raw_pop, nullif(params_billions, 0) AS params_billions, {_OR("architecture")} AS architecture, {_MEASURED("context_length")}, CASE WHEN is_trending THEN 1 ELSE 0 END AS is_trending, {_MEASURED("stars")}, {_MEASURED("downloads")}, {_OR("last_modified")} AS last_modified,
 bundle_key, CAST(bundle_offset AS BIGINT) AS bundle_offset, CAST(coalesce(bundle_size, 0) AS BIGINT) AS bundle_size, {_OR("trend_7d")} AS trend_7d, {_OR("license", "license_spdx")} AS license, {_OR("source_url")} AS source_url, {_OR("pipeline_tag")} AS pipeline_tag, {_OR("raw_image_url", "image_url")} AS image_url, {_MEASURED("vram_estimate_gb")}, {_OR("source", "source_platform")} AS source,
 left({_OR("task_categories")}, 500) AS task_categories, {_MEASURED("num_rows")}, {_OR("primary_language")} AS primary_language, {_MEASURED("forks")}, {_MEASURED("citation_count")}, {_OR("runtime_hardware")} AS runtime_hardware, {_MEASURED("vocab_size")}, {_MEASURED("num_layers")}, {_MEASURED("hidden_size")},
 left('[' || coalesce(nullif(array_to_string(list_transform(list_filter(list_transform(string_split(datasets_used, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: '"' || lower(x) || '"'), ','), ''), '') || ']', 500) AS datasets_used, left({_OR("quick_start")}, 1000) AS quick_start, vram_fp16_gb, vram_int8_gb, vram_int4_gb,
 '' AS readme_html, {_OR("ui_related_mesh")} AS ui_related_mesh, {_OR("search_vector")} AS search_vector, {_OR("canonical_url")} AS canonical_url, {_CITED} AS citation, CASE WHEN has_fulltext THEN 1 ELSE 0 END AS has_fulltext, CASE WHEN has_ollama OR has_gguf THEN 1 ELSE 0 END AS ollama_compatible, {_OR("hosted_on", none="'[]'")} AS hosted_on, {_LICENSED} AS license_type, CASE WHEN (has_ollama OR has_gguf) AND (params_billions IS NULL OR params_billions <= 13) THEN 1 ELSE 0 END AS can_run_local, {_OR("hosted_on_checked_at")} AS hosted_on_checked_at, benchmarks,
 {_MEASURED("num_heads")}, {_MEASURED("kv_heads")}, {_MEASURED("moe_experts")}, {_MEASURED("moe_active")}, nullif(sdk, '') AS sdk, running_status, size_category, {_MEASURED("files_count")}, nullif(modality, '') AS modality, {_MEASURED("published_year")}, primary_category"""


@register("project_served_rows", given(f"SELECT {_SERVED} FROM full_records", ENT, RAW, FULL))
def project_served_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the served table, all 71 columns, with nulls for what wasn't measured and citations of what is known."""
    return P.served_row(full_records(spark, d), own_site="host1.", note="Indexed")


@register("project_bundles", given("SELECT id, CASE WHEN coalesce(type, entity_type, 'model') = 'paper' THEN '' ELSE coalesce(nullif(left(coalesce(body_content, readme, ''), 2048), ''), description, '') END AS readme, coalesce(license, license_spdx, '') AS license, coalesce(source, source_platform, '') AS source, coalesce(params_billions, 0E0) AS params, '[]' AS relations FROM raw", ENT, RAW))
def project_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The heavy part as a JSON text; here read back from it."""
    at = lambda path: F.get_json_object("bundle", path)
    return P.bundle(raw_records(spark, d)).select("id", at("$.readme").alias("readme"), at("$.license").alias("license"), at("$.source").alias("source"), at("$.params_billions").cast("double").alias("params"), at("$.mesh_profile.relations").alias("relations"))


_AT = lambda *paths: "coalesce(" + ", ".join(f"json_extract_string(meta, '{p}')" for p in paths) + ")"


@register("project_distilled", given(f"""SELECT id, {', '.join(f"TRY_CAST({_AT(*paths)} AS DOUBLE) AS {c}" for c, paths in P.PROMOTED.items())}, coalesce(nullif(CAST(stars AS DOUBLE), 0), TRY_CAST({_AT('$.stars')} AS DOUBLE), CAST(stars AS DOUBLE)) AS stars, {_AT('$.language[0]', '$.language')} AS primary_language, {_AT('$.runtime_stage', '$.runtime.stage')} AS running_status, year(TRY_CAST({_AT('$.published_date')} AS DATE)) AS published_year, coalesce(primary_category, {_AT('$.primary_category', '$.categories[0]')}) AS primary_category, CASE WHEN params_billions > 0 THEN round(params_billions * 1.2E0, 1) END AS vram_int8_gb FROM raw""", ENT, RAW))
def project_distilled(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a JSON text as columns, each from the first place that has it."""
    return P.promoted(raw_records(spark, d)).select("id", *P.PROMOTED, "stars", "primary_language", "running_status", "published_year", "primary_category", "vram_int8_gb")


@register("project_api", given("SELECT id, score, NULL AS semantic, mesh_points / 5E0 AS authority, vram_gb AS estimate_gb, CAST(citations AS BIGINT) AS citation_count, CASE WHEN type = 'paper' THEN nullif(regexp_extract(slug || '-2401.0' || CAST(1000 + k % 9000 AS VARCHAR), '(\\d{4}\\.\\d{4,5})', 1), '') END AS arxiv_id FROM ent", ENT))
def project_api(spark: SparkSession, d: str) -> DataFrame:
    """P10: an entity in sections, of which some are read back."""
    e = entities(spark, d).withColumns({"fni_a": F.col("mesh_points") / 5.0, "fni_p": F.lit(None).cast("double"), "slug": F.concat("slug", F.lit("-2401.0"), (1000 + F.col("k") % 9000).cast("string"))})
    c = lambda path: F.col(f"entity.{path}")
    return P.nested(e).select("id", c("fni.score").alias("score"), c("fni.factors.semantic").alias("semantic"), c("fni.factors.authority").alias("authority"), c("specs.vram.estimate_gb").alias("estimate_gb"), c("stats.citation_count").cast("long").alias("citation_count"), c("links.arxiv_id").alias("arxiv_id"))


_CARD = "id, slug, name, type, coalesce(author, '') AS author, left(description, 120) AS description, array_to_string(tags[1:5], ',') AS tags, floor(score * 10 + 0.5) / 10 AS score"


@register("project_cards", given(f"SELECT {_CARD}, CASE WHEN type = 'model' THEN 'ranking' ELSE 'search' END AS list FROM ent", ENT))
def project_cards(spark: SparkSession, d: str) -> DataFrame:
    """What lists show of an entity."""
    return P.card(entities(spark, d)).withColumns({"tags": F.array_join("tags", ","), "list": F.when(F.col("type") == "model", "ranking").otherwise("search")})


@register("project_preload", given(f"r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, coalesce(likes, 0) DESC, slug, id) AS rn FROM ent) SELECT {_CARD}, rn FROM r WHERE rn <= 100", ENT))
def project_preload(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best cards of each type, in the one order of all lists."""
    top = R.top_n(entities(spark, d), ["type"], [F.desc("score"), F.coalesce("likes", F.lit(0)).desc(), F.asc("slug"), F.asc("id")], 100)
    return P.card(top).join(top.select("id", "rn"), "id").withColumn("tags", F.array_join("tags", ","))


@register("project_promoted", given("""a AS (SELECT k, id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN left(description, 20) ELSE description END AS description, CASE WHEN k % 3 = 0 THEN 0 ELSE likes END AS likes FROM ent WHERE k % 5 > 0), b AS (SELECT k, description, downloads AS likes FROM ent WHERE k % 5 < 4)
 SELECT a.id, CASE WHEN b.description <> '' AND (a.description = '' OR length(b.description) > 1.5 * length(a.description)) THEN b.description ELSE a.description END AS description, CASE WHEN b.likes IS NOT NULL AND coalesce(a.likes, 0) = 0 THEN b.likes ELSE a.likes END AS likes FROM a LEFT JOIN b USING (k)""", ENT))
def project_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Of two sources' columns the one that isn't empty, or a text that is much longer."""
    e, k = entities(spark, d), F.col("k")
    a = e.filter("k % 5 > 0").select("k", "id", F.when(k % 4 == 0, "").when(k % 4 == 1, F.substring("description", 1, 20)).otherwise(F.col("description")).alias("description"), F.when(k % 3 == 0, 0).otherwise(F.col("likes")).alias("likes"))
    b = e.filter("k % 5 < 4").select("k", "description", F.col("downloads").alias("likes"))
    both = a.alias("a").join(b.alias("b"), "k", "left")
    return both.select("id", P.better(F.col("a.description"), F.col("b.description"), text=True).alias("description"), P.better(F.col("a.likes"), F.col("b.likes")).alias("likes"))


_BILLIONS = "CASE WHEN TRY_CAST(nullif(regexp_extract(n, '(\\d+(?:\\.\\d+)?)\\s*[Bb](?:[^a-zA-Z]|$)', 1), '') AS DOUBLE) BETWEEN 0.1 AND 2000 THEN TRY_CAST(regexp_extract(n, '(\\d+(?:\\.\\d+)?)\\s*[Bb](?:[^a-zA-Z]|$)', 1) AS DOUBLE) END"


@register("project_specs", given(f"r AS (SELECT *, {_TEXT['name']} AS n FROM raw), p AS (SELECT *, coalesce(nullif(params_billions, 0), {_BILLIONS}) AS params FROM r) SELECT id, params, context_length AS context, round(params * 2.2E0, 1) AS memory, CASE WHEN author IS NOT NULL AND NOT contains(author, '-') THEN author ELSE upper(split_part(id, '--', 2)[1]) || split_part(id, '--', 2)[2:] END AS author FROM p", ENT, RAW))
def project_specs(spark: SparkSession, d: str) -> DataFrame:
    """Technical facts, from columns or else from name and id."""
    return P.technical(raw_records(spark, d))
