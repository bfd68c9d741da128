"""Queries: labels and texts of entities that follow from their own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import labels as L
from lodestack.functions import metadata as M
from lodestack.functions import text as X
from lodestack.plans.duck import ENT, RAW, cases, first_match, given
from lodestack.plans.registry import register
from lodestack.plans.scores import TODAY, days_since
from lodestack.sources.catalogue import entities, raw_records, read


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",")


@register("label_license_names", given(f"SELECT id, coalesce({cases('lower(trim(license))', L.LICENSE_NAMES)}, nullif(license, '')) AS license_name FROM ent", ENT))
def label_license_names(spark: SparkSession, d: str) -> DataFrame:
    """Usual names of licences."""
    return entities(spark, d).select("id", L.license_name(F.col("license")).alias("license_name"))


@register("label_categories", given(f"""t AS (SELECT id, arg_min(c, p) AS of_tag FROM (SELECT id, p, {cases('t', L.CATEGORY_OF)} AS c FROM (SELECT id, unnest(tags) AS t, unnest(range(len(tags))) AS p FROM ent)) WHERE c IS NOT NULL GROUP BY id)
 SELECT e.id, coalesce({cases('e.primary_category', L.CATEGORY_OF)}, {cases('CASE WHEN k % 2 = 0 THEN e.pipeline_tag END', L.CATEGORY_OF)}, t.of_tag, {first_match('lower(e.name)', L.CATEGORY_NAMES)}, 'text-generation') AS category FROM ent e LEFT JOIN t USING (id)""", ENT))
def label_categories(spark: SparkSession, d: str) -> DataFrame:
    """X11: category by source, pipeline, tags, name, or the default; every other entity has its pipeline hidden to reach the later steps."""
    pipeline = F.when(F.col("k") % 2 == 0, F.col("pipeline_tag"))
    return entities(spark, d).select("id", L.category(F.col("primary_category"), pipeline, F.col("tags"), F.col("name")).alias("category"))


_TASKS = f"""n AS (SELECT id, pipeline_tag, list_concat(tags, [CASE k % 4 WHEN 0 THEN 'Code ' WHEN 1 THEN 'math' WHEN 2 THEN 'rlhf' END]) AS tags, CASE k % 3 WHEN 0 THEN 'Qwen-Coder ' WHEN 1 THEN 'my-chat vl ' ELSE '' END || name AS name FROM ent),
 f AS (SELECT id, {cases('lower(trim(t))', L.TASK_OF)} AS task FROM (SELECT id, unnest(list_append(tags, lower(coalesce(pipeline_tag, '')))) AS t FROM n) UNION ALL """ + " UNION ALL ".join(f"SELECT id, '{t}' FROM n WHERE regexp_matches(lower(name), '{p}')" for t, p in L.TASK_NAMES.items()) + ")"


@register("label_tasks", given(f"{_TASKS}, g AS (SELECT id, string_agg(DISTINCT task, ',' ORDER BY task) AS tasks FROM f WHERE task IS NOT NULL GROUP BY id) SELECT n.id, coalesce(tasks, CASE WHEN pipeline_tag = 'text-generation' THEN 'chat' ELSE '' END) AS tasks FROM n LEFT JOIN g USING (id)", ENT))
def label_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of pipeline, tags and name."""
    k = F.col("k")
    tags = F.concat("tags", F.array(F.when(k % 4 == 0, "Code ").when(k % 4 == 1, "math").when(k % 4 == 2, "rlhf")))
    name = F.concat(F.when(k % 3 == 0, "Qwen-Coder ").when(k % 3 == 1, "my-chat vl ").otherwise(""), "name")
    return entities(spark, d).select("id", L.tasks(F.col("pipeline_tag"), F.array_compact(tags), name).alias("t")).select("id", _joined("t").alias("tasks"))


_BARE_FAMILY = "CASE " + " ".join(f"WHEN starts_with(key, '{f.replace('_', '').replace('-', '')}') THEN '{f}'" for f in L.FAMILIES) + " END"


@register("label_context_lengths", given(f"""f AS (SELECT id, model_type, lower(model_type) AS low, regexp_replace(regexp_replace(regexp_replace(lower(model_type), '{L.HEADS}', ''), '[-_]', '', 'g'), '{L.VARIANTS}', '') AS key FROM raw)
 SELECT id, model_type, coalesce({cases('key', L.CONTEXT_LENGTH)}, {cases("replace(low, '-', '_')", L.CONTEXT_LENGTH)}, {cases('low', L.CONTEXT_LENGTH)}, {cases(_BARE_FAMILY, L.CONTEXT_LENGTH)}) AS context FROM f""", ENT, RAW))
def label_context_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Context by architecture as a config names it."""
    return raw_records(spark, d).select("id", "model_type", L.context_length(F.col("model_type")).alias("context"))


_ASKED = "CASE k % 9 WHEN 0 THEN ' Chat ' WHEN 1 THEN 'my rag bot' WHEN 2 THEN 'Text-Generation' WHEN 3 THEN 'folding laundry' WHEN 4 THEN '' WHEN 5 THEN 'ner' WHEN 6 THEN 'stable-diffusion xl' WHEN 7 THEN 'transcriber of voices' END"
_HELD = "CASE " + " ".join(f"WHEN contains(low, '{a}') THEN '{p}'" for a, p in L.TASK_ALIASES.items()) + " END"


@register("label_task_pipelines", given(f"""a AS (SELECT k, {_ASKED} AS task, lower(trim({_ASKED})) AS low FROM ent),
 b AS (SELECT *, {cases('low', L.TASK_ALIASES)} AS alias, {_HELD} AS held FROM a)
 SELECT k, CASE WHEN task IS NULL OR task = '' THEN 'text-generation' WHEN low IN ({", ".join(f"'{p}'" for p in L.PIPELINES)}) THEN low ELSE coalesce(alias, held, low) END AS tag, CASE WHEN task IS NULL OR task = '' THEN 0.3E0 WHEN low IN ({", ".join(f"'{p}'" for p in L.PIPELINES)}) THEN 1E0 WHEN alias IS NOT NULL THEN 0.9E0 WHEN held IS NOT NULL THEN 0.7E0 ELSE 0.5E0 END AS confidence FROM b""", ENT))
def label_task_pipelines(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline of a task as people say it, with confidence."""
    return entities(spark, d).selectExpr("k", f"{_ASKED} AS task").select("k", L.pipeline_of_task(F.col("task")).alias("p")).select("k", "p.tag", "p.confidence")


@register("label_uses", given("""n AS (SELECT id, type, score, license, CASE WHEN type = 'model' AND pipeline_tag IS NOT NULL THEN pipeline_tag END AS p, list_concat(tags, [CASE k % 7 WHEN 0 THEN 'Code' WHEN 1 THEN 'RAG' WHEN 2 THEN 'sft' WHEN 3 THEN 'nlp' WHEN 4 THEN 'chat' WHEN 5 THEN 'deployment' ELSE 'cc-by-nc-4.0' END]) AS tags, k FROM ent),
 w AS (SELECT id, type, score, license, list_transform(CASE WHEN p IS NULL THEN tags ELSE list_append(tags, p) END, lambda t: lower(t)) AS t, list_transform(tags, lambda t: lower(t)) AS own FROM n),
 u AS (SELECT *, [""" + ", ".join(f"CASE WHEN type = '{kind}' AND ({' OR '.join(f'''list_contains(t, '{t}')''' for t, v in uses.items() if v == use)}) THEN '{use}' END" for kind, uses in L.USES.items() for use in dict.fromkeys(uses.values())) + """, CASE WHEN score >= 90 THEN 'SOTA Performance' END] AS g FROM w)
 SELECT id, array_to_string(list_filter(g, lambda x: x IS NOT NULL)[1:3], ',') AS good, CASE WHEN type = 'model' THEN array_to_string(list_filter([CASE WHEN score < 50 AND score > 0 THEN 'Experimental / High Latency' END, CASE WHEN contains(array_to_string(own, ' '), 'cc-by-nc') THEN 'Non-Commercial Use' END], lambda x: x IS NOT NULL)[1:2], ',') ELSE '' END AS limited FROM u""", ENT))
def label_uses(spark: SparkSession, d: str) -> DataFrame:
    """What an entity is good for, and its limits."""
    k = F.col("k")
    tag = F.when(k % 7 == 0, "Code").when(k % 7 == 1, "RAG").when(k % 7 == 2, "sft").when(k % 7 == 3, "nlp").when(k % 7 == 4, "chat").when(k % 7 == 5, "deployment").otherwise("cc-by-nc-4.0")
    e = entities(spark, d).withColumn("tags", F.concat("tags", F.array(tag)))
    pipeline = F.when(F.col("type") == "model", F.col("pipeline_tag"))
    good = L.good_for(F.col("type"), F.col("tags"), pipeline, F.col("score"))
    return e.select("id", F.array_join(good, ",").alias("good"), F.array_join(L.limits(F.col("type"), F.col("tags"), F.col("license"), F.col("score")), ",").alias("limited"))


_INSIGHTS = """CASE WHEN score > 0 THEN 'FNI Score=' || CAST(score AS VARCHAR) || '/' || CASE WHEN score > 90 THEN 'High FNI signal' WHEN score > 70 THEN 'Medium FNI signal' ELSE 'Low FNI signal' END END,
 'Params=' || CASE WHEN params_billions <> 0 THEN CAST(params_billions AS VARCHAR) || 'B' ELSE '-' END || '/' || CASE WHEN params_billions < 3 THEN 'Tiny' WHEN params_billions > 100 THEN 'Massive' ELSE '' END,
 'Context=' || CASE WHEN context_length <> 0 THEN CAST(CAST(floor(context_length / 1024E0 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE '-' END || '/' || CASE WHEN context_length >= 128000 THEN 'Long' ELSE '' END,
 CASE WHEN vram_gb <> 0 THEN 'Est. VRAM=~' || CAST(CAST(ceil(vram_gb) AS BIGINT) AS VARCHAR) || 'GB/' || CASE WHEN vram_gb <= 8 THEN '8G GPU' WHEN vram_gb <= 24 THEN '24G GPU' ELSE 'H100+' END END,
 CASE WHEN license <> '' THEN 'License=' || upper(split_part(lower(license), '-', 1)) || '/' || CASE WHEN contains(lower(license), 'apache') OR contains(lower(license), 'mit') THEN 'Commercial' ELSE 'Restricted' END END"""


@register("label_insights", given(f"SELECT id, array_to_string(list_filter([{_INSIGHTS}], lambda x: x IS NOT NULL), ';') AS insights FROM ent WHERE type = 'model'", ENT))
def label_insights(spark: SparkSession, d: str) -> DataFrame:
    """A model's facts at a glance."""
    found = L.insights(F.col("score"), F.col("params_billions"), F.col("context_length"), F.col("vram_gb"), F.lit(None).cast("string"), F.col("license"))
    text = F.transform(found, lambda x: F.concat(x["label"], F.lit("="), x["value"], F.lit("/"), F.coalesce(x["badge"], F.lit(""))))
    return entities(spark, d).filter("type = 'model'").select("id", F.array_join(text, ";").alias("insights"))


@register("label_quality", given("""SELECT r.id, least(100, CASE WHEN length(body_content) > 200 THEN 20 ELSE 0 END + CASE WHEN length(body_content) > 500 THEN 10 ELSE 0 END + least(20, coalesce(json_array_length(meta, '$.authors'), 0) * 5) + 20 + CASE WHEN json_extract_string(meta, '$.pdf_url') IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN length(title) > 20 THEN 10 ELSE 0 END) AS paper,
 floor((CASE WHEN length(readme) > 500 THEN 10 ELSE 0 END + CASE WHEN license_spdx IS NOT NULL THEN 10 ELSE 0 END + least(30E0, log10(coalesce(likes, 0) + 1) * 10)) * 10 + 0.5) / 10 AS entity FROM raw r""", ENT, RAW))
def label_quality(spark: SparkSession, d: str) -> DataFrame:
    """Points of papers and of entities."""
    authors = F.size(F.from_json(F.get_json_object("meta", "$.authors"), "array<string>"))
    paper = L.paper_quality(F.col("body_content"), F.greatest(authors, F.lit(0)), F.col("tags"), F.get_json_object("meta", "$.pdf_url"), F.col("title"))
    return raw_records(spark, d).select("id", paper.alias("paper"), L.entity_quality(F.col("readme"), F.lit(None).cast("string"), F.col("license_spdx"), F.col("likes")).alias("entity"))


_RANKED = f"coalesce(list_position([{', '.join(f'''{q!r}''' for q in L.QUANTISATIONS)}], v), 999)"


@register("label_gguf_variants", given(f"""f AS (SELECT id, unnest(string_split(files, ',')) AS f, unnest(range(len(string_split(files, ',')))) AS p FROM raw WHERE files IS NOT NULL),
 v AS (SELECT id, upper(regexp_extract(f, '(?i)[_-](Q\\d+_[A-Z0-9_]+|f16|f32|int[48])', 1)) AS v, min(p) AS p FROM f WHERE ends_with(lower(f), '.gguf') GROUP BY 1, 2)
 SELECT id, string_agg(v, ',' ORDER BY {_RANKED}, p) AS variants FROM v WHERE v <> '' GROUP BY id""", ENT, RAW))
def label_gguf_variants(spark: SparkSession, d: str) -> DataFrame:
    """Quantisations of a list of files."""
    return raw_records(spark, d).select("id", L.gguf_variants(F.split("files", ",")).alias("v")).filter(F.size("v") > 0).select("id", _joined("v").alias("variants"))


_README = "'Read me. ' || CASE k % 5 WHEN 0 THEN '```Shell' || chr(10) || 'make all && make check install' || chr(10) || '``` then ```' || chr(10) || 'x' || '```' WHEN 1 THEN '```python' || chr(10) || 'import ring' || chr(10) || 'ring.run(' || CAST(k AS VARCHAR(20)) || ', fast=True)' || chr(10) || '```' WHEN 2 THEN '```bash' || chr(10) || 'pip install ring-' || slug || chr(10) || '``` and ```js' || chr(10) || 'const r = require(1); r.run(' || CAST(k AS VARCHAR(20)) || ');```' WHEN 3 THEN '```short```' ELSE 'no code' END"
_BLOCK = lambda mark: f"trim(regexp_extract(r, '(?i)```{mark}\\s*([\\s\\S]*?)```', 1), chr(10) || ' ')"
_USABLE = lambda mark: f"length({_BLOCK(mark)}) >= 20 AND NOT (starts_with({_BLOCK(mark)}, 'pip install') AND len(string_split({_BLOCK(mark)}, chr(10))) < 3)"


@register("text_code_blocks", given(f"b AS (SELECT id, {_README} AS r FROM ent), c AS (SELECT id, CASE " + " ".join(f"WHEN {_USABLE(m)} THEN '{n}'" for m, n in L.CODE_LANGUAGES.items()) + " END AS language, CASE " + " ".join(f"WHEN {_USABLE(m)} THEN {_BLOCK(m)}" for m in L.CODE_LANGUAGES) + " END AS code FROM b) SELECT id, language, left(code, 2000) AS code, len(string_split(code, chr(10))) AS lines FROM c WHERE language IS NOT NULL", ENT))
def text_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first usable block of code of a text."""
    e = entities(spark, d).selectExpr("id", f"{_README} AS r")
    return e.select("id", L.code_block(F.col("r")).alias("b")).filter("b IS NOT NULL").select("id", "b.language", "b.code", F.col("b.lines").cast("long").alias("lines"))


@register("stats_benchmark_delta", given("b AS (SELECT k, likes % 100 AS mmlu, CASE WHEN k % 5 > 0 THEN downloads % 100 END AS humaneval FROM ent WHERE type = 'model') SELECT x.k, round(CASE WHEN coalesce(y.mmlu, 0) = 0 THEN 0E0 ELSE (x.mmlu - y.mmlu) * 100E0 / y.mmlu END, 6) AS mmlu, round(CASE WHEN coalesce(y.humaneval, 0) = 0 THEN 0E0 ELSE (x.humaneval - y.humaneval) * 100E0 / y.humaneval END, 6) AS humaneval FROM b x JOIN b y ON y.k = x.k + 5", ENT))
def stats_benchmark_delta(spark: SparkSession, d: str) -> DataFrame:
    """Change of each benchmark between two models, in percent."""
    b = entities(spark, d).filter("type = 'model'").select("k", (F.col("likes") % 100).alias("mmlu"), F.when(F.col("k") % 5 > 0, F.col("downloads") % 100).alias("humaneval"))
    both = b.alias("x").join(b.withColumn("k", F.col("k") - 5).alias("y"), "k")
    return both.select("k", *(F.round(L.percent_change(F.col(f"x.{c}"), F.col(f"y.{c}")), 6).alias(c) for c in ("mmlu", "humaneval")))


@register("stats_metric_rows", given("SELECT id, key, CAST(value AS DOUBLE) AS value, CASE key WHEN 'likes' THEN 'Likes' WHEN 'downloads' THEN 'Downloads' ELSE 'Mesh Points' END AS label FROM (SELECT id, unnest(['likes', 'downloads', 'mesh_points']) AS key, unnest([likes, downloads, mesh_points]) AS value FROM ent) WHERE value IS NOT NULL", ENT))
def stats_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metrics as rows with labels."""
    e = entities(spark, d).select("id", *(F.col(c).cast("double").alias(c) for c in ("likes", "downloads", "mesh_points")))
    rows = e.unpivot("id", ["likes", "downloads", "mesh_points"], "key", "value").filter("value IS NOT NULL")
    return rows.withColumn("label", F.initcap(F.replace("key", F.lit("_"), F.lit(" "))))


@register("label_defaults", given(f"SELECT id, coalesce(nullif(params_billions, 0), TRY_CAST(nullif(regexp_extract(name, '(\\d+\\.?\\d*)\\s*[Bb]', 1), '') AS DOUBLE), {L.DEFAULT_PARAMS}E0) AS params, coalesce(context_length, {L.DEFAULT_CONTEXT}) AS context, {first_match('lower(array_to_string(tags, chr(32)))', {f: f for f in L.FAMILY_NAMES}, repr(L.DEFAULT_FAMILY))} AS family FROM ent", ENT))
def label_defaults(spark: SparkSession, d: str) -> DataFrame:
    """What stands for unknown facts."""
    named = F.nullif(F.regexp_extract("name", r"(\d+\.?\d*)\s*[Bb]", 1), F.lit("")).cast("double")
    return entities(spark, d).select("id", F.coalesce(F.nullif("params_billions", F.lit(0.0)), named, F.lit(L.DEFAULT_PARAMS)).alias("params"), F.coalesce("context_length", F.lit(L.DEFAULT_CONTEXT)).alias("context"), L.family(F.array_join("tags", " ")).alias("family"))


@register("label_velocity", given(f"a AS (SELECT id, coalesce(likes, 0) AS l, coalesce(downloads, 0) AS w, greatest(coalesce(date_diff('day', last_modified, DATE '{TODAY}'), 1), 1) AS age FROM ent) SELECT id, floor((l / CAST(age AS DOUBLE) + w / CAST(age AS DOUBLE) / 10) * 1000 + 0.5) / 1000 AS velocity, round(l * 2 + w * 0.1E0, 6) AS popularity FROM a", ENT))
def label_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity and popularity."""
    return entities(spark, d).select("id", (F.floor(L.velocity(F.col("likes"), F.col("downloads"), F.coalesce(days_since("last_modified"), F.lit(1))) * 1000 + 0.5) / 1000).alias("velocity"), F.round(L.popularity(F.col("likes"), F.col("downloads")), 6).alias("popularity"))


@register("label_weeks", "SELECT DISTINCT day, CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS iso, CAST(year(day) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil((date_diff('day', date_trunc('year', day), day) + dayofweek(CAST(date_trunc('year', day) AS DATE)) + 1) / 7E0) AS INT) AS VARCHAR), 2, '0') AS plain FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)")
def label_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Week labels, by ISO and plainly counted."""
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", M.iso_week(F.col("day")).alias("iso"), L.plain_week(F.col("day")).alias("plain"))


_BENCH = "CASE k % 6 WHEN 0 THEN 'qwen-qwen2-5-72b' WHEN 1 THEN 'Llama_3.1-8B-Instruct' WHEN 2 THEN '-phi-3-mini-chat-' WHEN 3 THEN 'deepseek-v2' WHEN 4 THEN 'gemma-2-9b-it' ELSE '' END || CASE WHEN k % 12 > 5 THEN '-base' ELSE '' END"
_BK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(b), '[_.]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '-instruct$', ''), '-chat$', ''), '-base$', '')"
_FAM = "CASE " + " ".join(f"WHEN starts_with(base, '{a}') THEN '{b}' || substr(base, {len(a) + 1})" for a, b in L.FAMILY_PREFIXES.items()) + " END"


@register("id_benchmark_variants", given(f"""b AS (SELECT k, {_BENCH} AS b FROM ent), c AS (SELECT k, b, {_BK} AS base FROM b), e AS (SELECT *, regexp_replace(base, '-(\\d+)-(\\d+)([^-]*)$', '-\\1.\\2\\3') AS dotted, {_FAM} AS fam FROM c)
 SELECT k, base, array_to_string(list_filter([base, base || '-instruct', base || '-chat', base || '-base', CASE WHEN dotted <> base THEN dotted END, CASE WHEN dotted <> base THEN dotted || '-instruct' END, fam, fam || '-instruct'], lambda x: x IS NOT NULL), ' ') AS variants FROM e""", ENT))
def id_benchmark_variants(spark: SparkSession, d: str) -> DataFrame:
    """Ids of benchmarks and the names that may stand for them."""
    b = entities(spark, d).selectExpr("k", f"{_BENCH} AS b")
    return b.select("k", L.benchmark_key(F.col("b")).alias("base"), F.array_join(L.benchmark_variants(F.col("b")), " ").alias("variants"))


@register("label_display_names", given("""n AS (SELECT id, string_split(id, '--')[-1] AS last, CASE k % 6 WHEN 0 THEN name WHEN 1 THEN slug WHEN 2 THEN NULL WHEN 3 THEN '2401.' || lpad(CAST(k % 99999 AS VARCHAR), 5, '0') WHEN 4 THEN 'Unknown' ELSE id END AS name, k FROM ent)
 SELECT id, CASE WHEN k % 6 = 0 THEN name WHEN k % 6 = 3 THEN 'Paper ' || last ELSE array_to_string(list_transform(list_filter(string_split(regexp_replace(last, '[-_]', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') END AS shown FROM n""", ENT))
def label_display_names(spark: SparkSession, d: str) -> DataFrame:
    """Names fit to be shown."""
    k = F.col("k")
    name = F.when(k % 6 == 0, F.col("name")).when(k % 6 == 1, F.col("slug")).when(k % 6 == 2, F.lit(None)).when(k % 6 == 3, F.concat(F.lit("2401."), F.lpad((k % 99999).cast("string"), 5, "0"))).when(k % 6 == 4, "Unknown").otherwise(F.col("id"))
    return entities(spark, d).select("id", L.display_name(name, F.col("id")).alias("shown"))


@register("label_tags", given("SELECT id, array_to_string(list_filter(list_transform(list_concat(tags, ['  ', ' Mixed Case ', repeat('x', 50)]), lambda t: lower(trim(t))), lambda t: length(t) BETWEEN 1 AND 49), ',') AS tags FROM ent", ENT))
def label_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags in one form, those of a sensible length."""
    more = F.array(F.lit("  "), F.lit(" Mixed Case "), F.lit("x" * 50))
    return entities(spark, d).select("id", F.array_join(M.normal_tags(F.concat("tags", more)), ",").alias("tags"))


_ARTICLE = "'---' || chr(10) || 'title: ' || name || chr(10) || 'slug: a:' || slug || chr(10) || 'no colon' || chr(10) || '---' || chr(10) || 'Lead of ' || id || chr(10) || '## First part' || chr(10) || 'Body ' || CAST(k AS VARCHAR(20)) || chr(10) || '## Second' || chr(10) || 'More' || chr(10)"


@register("text_front_matter", given("SELECT id, name AS title, 'a:' || slug AS slug, 2 AS fields, 'Body ' || CAST(k AS VARCHAR) AS first_part, 'More' AS second FROM ent", ENT))
def text_front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Fields between lines of dashes, and sections by their headings."""
    e = entities(spark, d).selectExpr("id", f"{_ARTICLE} AS a").select("id", X.front_matter(F.col("a")).alias("f"), X.sections(F.col("a")).alias("s"))
    return e.select("id", F.col("f")["title"].alias("title"), F.col("f")["slug"].alias("slug"), F.size("f").alias("fields"), F.col("s")["First part"].alias("first_part"), F.col("s")["Second"].alias("second"))


@register("text_richer", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > octet_length(encode(repeat('filler ', 1 + CAST(doc_id % 400 AS INT)))) THEN 'text' ELSE 'other' END AS source, greatest(octet_length(encode(text)), 7 * (1 + doc_id % 400)) AS n_bytes, CASE WHEN greatest(octet_length(encode(text)), 7 * (1 + doc_id % 400)) >= 200 THEN 'PARTIAL' ELSE 'SKIP' END AS class FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '#', '', 'g') AS text FROM documents)")
def text_richer(spark: SparkSession, d: str) -> DataFrame:
    """The longer one of two texts, in bytes, with its class."""
    docs = read(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit("")).alias("text"), F.expr("repeat('filler ', 1 + cast(doc_id % 400 as int))").alias("other"))
    best = docs.withColumn("best", X.richer(F.col("text"), F.col("other")))
    return best.select("doc_id", F.when(F.octet_length("text") > F.octet_length("other"), "text").otherwise("other").alias("source"), F.octet_length("best").cast("long").alias("n_bytes"), X.content_class(F.col("best")).alias("class"))


@register("text_clean_citations", given("SELECT id, '@misc{ author={' || coalesce(author, '') || '}, title={' || name || '}}' AS citation, 'Some words and a label ' || name AS description FROM ent", ENT))
def text_clean_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations without internal keys, descriptions without markup."""
    e = entities(spark, d)
    raw = F.concat(F.lit("@misc{ , author={"), F.coalesce("author", F.lit("")), F.lit("}, \n title={[Own-"), "slug", F.lit("]"), "name", F.lit("}}"))
    markup = F.concat(F.lit("---\na: b\n---\n\n<p class='x'>Some words</p> and ![pic](u.png)[a label](http://x.y) https://example.org/"), F.lit("x" * 30), F.lit(" "), "name")
    return e.select("id", X.clean_citation(raw, "own").alias("citation"), X.clean_description(markup).alias("description"))


@register("text_paper_refs", given("SELECT id, 'arxiv 2401.' || lpad(CAST(k % 99999 AS VARCHAR), 5, '0') AS text, '2401.' || lpad(CAST(k % 99999 AS VARCHAR), 5, '0') || ',1706.03762' AS papers, 'squad_v2,' || slug AS datasets, CASE WHEN k % 2 = 0 THEN 'org/' || slug ELSE '' END AS base FROM ent", ENT))
def text_paper_refs(spark: SparkSession, d: str) -> DataFrame:
    """Papers, data sets and base models that a text names."""
    number = F.concat(F.lit("2401."), F.lpad((F.col("k") % 99999).cast("string"), 5, "0"))
    text = F.concat(F.lit("See arXiv:"), number, F.lit("v3 and 1706.03762, again "), number, F.lit(". datasets: squad_v2, https://huggingface.co/datasets/"), "slug", F.lit(" "), F.when(F.col("k") % 2 == 0, F.concat(F.lit("base_model: org/"), "slug")).otherwise(""))
    return entities(spark, d).select("id", F.concat(F.lit("arxiv "), number).alias("text"), F.array_join(M.arxiv_ids(text), ",").alias("papers"), F.array_join(X.dataset_refs(text), ",").alias("datasets"), X.base_model_ref(text).alias("base"))


@register("label_stamps", given("SELECT id, CASE WHEN k % 3 = 0 THEN NULL WHEN last_modified IS NULL THEN NULL ELSE strftime(last_modified, '%Y-%m-%d') END AS lastmod, 'R&amp;D &lt;' || slug || '&gt; &quot;x&quot;' AS escaped FROM ent", ENT))
def label_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps as days, null for what doesn't parse; text escaped for XML."""
    stamp = F.when(F.col("k") % 3 == 0, "INVALID-TS").otherwise(F.col("last_modified").cast("string"))
    return entities(spark, d).select("id", F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd").alias("lastmod"), X.xml_escaped(F.concat(F.lit("R&D <"), "slug", F.lit('> "x"'))).alias("escaped"))


@register("label_telemetry", "SELECT event_id, CASE WHEN s < 400 THEN 'ok' WHEN s < 500 THEN 'client_error' ELSE 'server_error' END AS status, CASE WHEN h = '' THEN 'direct' WHEN h LIKE '%google.%' OR h LIKE '%bing.%' THEN 'search' WHEN h LIKE '%github.com' OR h LIKE '%huggingface.co' THEN 'developer' ELSE 'other' END AS referer, CASE WHEN event_id % 3 = 0 THEN 'agent' ELSE 'human' END AS audience FROM (SELECT event_id, 200 + (event_id % 4) * 100 AS s, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'www.google.com' WHEN 2 THEN 'github.com' WHEN 3 THEN 'huggingface.co' ELSE 'example.org' END AS h FROM events)")
def label_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Classes of an event's status, referer and audience, from closed vocabularies."""
    n = F.col("event_id")
    url = F.when(n % 5 == 0, "").when(n % 5 == 1, "https://www.google.com/search?q=x").when(n % 5 == 2, "https://github.com/a/b").when(n % 5 == 3, "https://huggingface.co").otherwise("http://example.org:8080/p")
    agent = F.when(n % 3 == 0, "ClaimBot/1.0 (crawler)").otherwise("Mozilla/5.0")
    return read(spark, d, "events").select("event_id", M.status_class(200 + (n % 4) * 100).alias("status"), M.referer_class(url).alias("referer"), M.audience(agent).alias("audience"))
