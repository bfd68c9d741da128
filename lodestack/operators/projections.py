"""Projections of raw records: each output column is the first of its sources that is there, in one select."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import metadata as M

# The names under which a record may hold a column, in order of preference, and what stands for none.
TEXTS = {
    "name": (["name", "title", "display_name"], ""), "type": (["type", "entity_type"], "model"), "author": (["author", "creator", "organization"], ""),
    "last_modified": (["last_modified", "last_updated"], ""), "license": (["license", "license_spdx"], ""), "source": (["source"], ""),
    "pipeline_tag": (["pipeline_tag"], ""), "primary_category": (["primary_category"], ""), "umid": (["umid"], ""), "slug": (["slug"], ""),
}
NUMBERS = {"downloads": (["downloads"], 0.0), "likes": (["likes"], 0.0), "citations": (["citations"], 0.0), "fni_score": (["fni_score", "fni"], 0.0)}
#: The columns that relations are read from.
RELATION_FIELDS = ["tags", "velocity", "base_model", "datasets", "arxiv_refs", "models_used", "sdk", "implementations", "dependencies", "features", "knowledge_tags", "benchmarks", "source_url"]
# The columns that a merged record keeps beside those of the slim one, where a source has them.
KEPT = [
    "body_content", "has_fulltext", "relations", "category", "summary", "params_billions", "architecture", "context_length",
    "is_trending", "trend_7d", "_trend_7d", "source_url", "image_url", "raw_image_url", "canonical_url", "vram_estimate_gb",
    "vram_fp16_gb", "vram_int8_gb", "vram_int4_gb", "task_categories", "num_rows", "primary_language", "forks", "citation_count",
    "runtime_hardware", "vocab_size", "num_layers", "hidden_size", "datasets_used", "quick_start", "citation", "has_ollama",
    "has_gguf", "ollama_compatible", "can_run_local", "hosted_on", "hosted_on_checked_at", "ui_related_mesh", "search_vector",
    "meta_json", "meta", "fni_metrics", "license_spdx", "source_platform", "benchmarks", "paper_abstract", "mesh_profile",
    "changelog", "quick_insights", "use_cases", "quantization", "html_readme", "created_at", "display_description", "readme",
    "base_model", "gguf_variants", "raw_pop", "num_heads", "kv_heads", "moe_experts", "moe_active", "sdk", "running_status",
    "size_category", "files_count", "modality", "published_year", "published_date",
]
#: Where a fact may stand in the JSON text of a record, in order of preference.
PROMOTED = {
    "num_rows": ["$.rows_count"], "hidden_size": ["$.hidden_size", "$.config.hidden_size", "$.config.n_embd", "$.config.d_model", "$.config.dim"],
    "num_layers": ["$.num_hidden_layers", "$.num_layers", "$.config.num_hidden_layers", "$.config.n_layer", "$.config.n_layers"],
    "moe_experts": ["$.moe_experts", "$.config.num_local_experts", "$.config.num_experts", "$.config.n_experts", "$.config.n_routed_experts"],
}
SUMMARY = 250


def first_of(df: DataFrame, names: Sequence[str], default=None) -> Column:
    """The first of the columns that df has and that is not null."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(default)) if there or default is not None else F.lit(None)


def plain_excerpt(text: Column) -> Column:
    """The start of a text without signs and tags: 300 characters are looked at, 250 stay."""
    start = F.regexp_replace(F.substring(text, 1, 300), "[#*`]", "")
    open_ = F.regexp_replace(F.regexp_replace(start, "<[^>]*>", " "), "<[^>]*$", "")
    return F.substring(F.trim(F.regexp_replace(F.replace(open_, F.lit(">"), F.lit(" ")), r"\s+", " ")), 1, SUMMARY)


def description(df: DataFrame) -> Column:
    """The description, or the summary; one of under five bytes gives way to an excerpt of the body, if there is one."""
    given = first_of(df, ["description", "summary"], "")
    body = first_of(df, ["readme", "content", "html_readme", "body_content"], "")
    return F.when(F.octet_length(given) >= 5, given).otherwise(plain_excerpt(body))


def _slim_columns(df: DataFrame) -> list[Column]:
    texts = [first_of(df, names, default).alias(c) for c, (names, default) in TEXTS.items()]
    numbers = [first_of(df, names, default).cast("double").alias(c) for c, (names, default) in NUMBERS.items()]
    stars = first_of(df, ["stars", "github_stars"]).cast("double").alias("stars")
    return [F.col("id"), *texts, description(df).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), stars, *numbers]


def slim(df: DataFrame) -> DataFrame:
    """The columns that rankings need; stars stay null where a source doesn't count them."""
    return df.select(*_slim_columns(df))


def for_relations(df: DataFrame) -> DataFrame:
    """The columns that relations are extracted from, and nothing heavy; those that a source doesn't have are left out."""
    own = ["slug", "type", "name"]
    texts = [first_of(df, *TEXTS[c]).alias(c) for c in own]
    return df.select("id", *texts, F.coalesce("description", F.lit("")).alias("description"), first_of(df, *NUMBERS["fni_score"]).cast("double").alias("fni_score"), *(c for c in RELATION_FIELDS if c in df.columns))


def for_merging(df: DataFrame) -> DataFrame:
    """slim() with the columns that later steps fall back on, as they are."""
    return df.select(*_slim_columns(df), *(c for c in KEPT if c in df.columns))


def number(column: Column, default: float | None = 0.0) -> Column:
    """A number, or what stands for none: 0 for counts, null for what wasn't measured."""
    got = column.try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text: lists joined, structures as JSON; null if df doesn't have it."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        plain = not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType))
        return F.array_join(F.col(name).cast("array<string>"), ", ") if plain else F.to_json(name)
    return F.to_json(name) if isinstance(kind, (T.StructType, T.MapType)) else F.col(name).cast("string")


def first_text(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is a text of one character or more; null if none is."""
    return F.coalesce(*(F.nullif(as_text(df, n), F.lit("")) for n in names))


def flag(df: DataFrame, name: str) -> Column:
    """Whether a column holds true, a number other than 0, or a text."""
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return F.coalesce(F.col(name) != ("" if isinstance(kind, T.StringType) else 0), F.lit(False))


def table_row(df: DataFrame) -> DataFrame:
    """A row of the analytical mirror, 23 columns: texts never null, lists joined, numbers never null, the semantic factor 50 where it
    isn't known."""
    text = lambda *names, default="": F.coalesce(first_text(df, *names), F.lit(default))
    count = lambda *names: number(first_of(df, names))
    texts = {"id": text("id", "slug"), "umid": text("umid", "id"), "name": text("name", "display_name"), "type": text("type", "entity_type", default="model"), "author": text("author"), "category": text("category"), "tags": text("tags")}
    factors = {"fni_score": count("fni_score", "fni"), "fni_s": number(first_of(df, ["fni_s"]), 50.0), **{f: count(f) for f in ("fni_a", "fni_p", "fni_r", "fni_q")}}
    counts = {"downloads": count("downloads").cast("long"), "stars": count("stars", "likes").cast("int"), "params_billions": count("params_billions", "params"), "context_length": count("context_length").cast("long")}
    rest = {"license": text("license", "license_spdx"), "pipeline_tag": text("pipeline_tag", "task"), "source": text("source", "source_platform"), "primary_language": text("primary_language"), "last_modified": text("last_modified", "updated_at"), "is_trending": flag(df, "is_trending")}
    return df.select(*(c.alias(n) for n, c in (texts | factors | counts | rest).items()))


#: Characters of a text of a served row; of its instructions.
LONG, INSTRUCTIONS = 500, 1000


def datasets_json(df: DataFrame) -> Column:
    """The data sets of a record, a list or a text with commas, as a JSON list in lower case."""
    if "datasets_used" not in df.columns:
        return F.lit("[]")
    c = F.col("datasets_used")
    if not isinstance(df.schema["datasets_used"].dataType, T.ArrayType):
        c = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.to_json(F.transform(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), F.lower))


def served_row(df: DataFrame, own_site: str | None = None, note: str | None = None) -> DataFrame:
    """A row of the served table, 71 columns in its order.

    Three kinds: texts that are empty where nothing is known; counts that were not measured, and facts of the last group, null; scores
    0. Long texts are cut, flags and citation are derived (own_site and note as in metadata.citation). Heavy HTML stays in the bundle."""
    text = lambda *names, default="": F.coalesce(first_text(df, *names), F.lit(default))
    measured = lambda name: number(F.nullif(as_text(df, name), F.lit("")), None)
    score = lambda name: number(as_text(df, name))
    factor = lambda f: F.coalesce(number(as_text(df, f"fni_{f}"), None), F.get_json_object(as_text(df, "fni_metrics"), f"$.{f}").try_cast("double"), F.lit(0.0))
    cut = lambda c, n=LONG: F.substring(c, 1, n)
    local = flag(df, "has_ollama") | flag(df, "has_gguf")
    params = F.nullif(measured("params_billions"), F.lit(0.0))
    benchmarks = first_text(df, "benchmarks") if not isinstance(df.schema["benchmarks"].dataType if "benchmarks" in df.columns else None, T.ArrayType) else F.to_json("benchmarks")
    year = F.coalesce(measured("published_year"), F.year(F.try_to_timestamp(F.coalesce(F.get_json_object(as_text(df, "meta"), "$.published_date"), as_text(df, "published_date")))).cast("double"))
    cited = M.citation(first_text(df, "id"), first_text(df, "name", "title", "display_name"), [as_text(df, c) for c in ("id", "slug", "umid")], first_text(df, "author"), year, first_text(df, "source_url"), own_site, note)
    who = {"id": text("id"), "umid": text("umid", "id"), "slug": text("slug"), "name": text("name", "display_name"), "type": text("type", default="model"), "author": text("author"), "summary": description(df), "category": text("category", "primary_category"), "tags": cut(text("tags"))}
    ranked = {"fni_score": score("fni_score"), "fni_percentile": text("fni_percentile"), **{f"fni_{f}": factor(f) for f in "saprq"}, "raw_pop": score("raw_pop"), "params_billions": params, "architecture": text("architecture"), "context_length": measured("context_length"), "is_trending": flag(df, "is_trending").cast("int"), "stars": measured("stars"), "downloads": measured("downloads"), "last_modified": text("last_modified")}
    stored = {"bundle_key": text("bundle_key"), "bundle_offset": score("bundle_offset").cast("long"), "bundle_size": score("bundle_size").cast("long"), "trend_7d": text("_trend_7d", "trend_7d"), "license": text("license", "license_spdx"), "source_url": text("source_url"), "pipeline_tag": text("pipeline_tag"), "image_url": text("raw_image_url", "image_url"), "vram_estimate_gb": measured("vram_estimate_gb"), "source": text("source", "source_platform")}
    facts = {"task_categories": cut(text("task_categories")), "num_rows": measured("num_rows"), "primary_language": text("primary_language"), "forks": measured("forks"), "citation_count": measured("citation_count"), "runtime_hardware": text("runtime_hardware"), **{c: measured(c) for c in ("vocab_size", "num_layers", "hidden_size")}, "datasets_used": cut(datasets_json(df)), "quick_start": cut(text("quick_start"), INSTRUCTIONS), **{c: measured(c) for c in ("vram_fp16_gb", "vram_int8_gb", "vram_int4_gb")}}
    served = {"readme_html": F.lit(""), "ui_related_mesh": text("ui_related_mesh"), "search_vector": text("search_vector"), "canonical_url": text("canonical_url"), "citation": cut(cited), "has_fulltext": flag(df, "has_fulltext").cast("int"), "ollama_compatible": local.cast("int"), "hosted_on": text("hosted_on", default="[]"), "license_type": M.license_class(first_text(df, "license", "license_spdx")), "can_run_local": (local & (params.isNull() | (params <= 13))).cast("int"), "hosted_on_checked_at": text("hosted_on_checked_at"), "benchmarks": benchmarks}
    hot = {**{c: measured(c) for c in ("num_heads", "kv_heads", "moe_experts", "moe_active")}, **{c: first_text(df, c) for c in ("sdk", "running_status", "size_category")}, "files_count": measured("files_count"), "modality": first_text(df, "modality"), "published_year": measured("published_year"), "primary_category": first_text(df, "primary_category")}
    return df.select(*(c.alias(n) for n, c in (who | ranked | stored | facts | served | hot).items()))


def bundle(df: DataFrame, body: int = 2048) -> DataFrame:
    """(id, bundle): the heavy part of a record as a JSON text. Papers have no body; others at most `body` characters, or the description."""
    text = F.coalesce("body_content", "readme", F.lit(""))
    kind = first_of(df, *TEXTS["type"])
    readme = F.when(kind == "paper", "").otherwise(F.coalesce(F.nullif(F.substring(text, 1, body), F.lit("")), "description", F.lit("")))
    empty = F.array().cast("array<string>")
    fields = [readme.alias("readme"), first_of(df, *TEXTS["license"]).alias("license"), F.coalesce("source_url", F.lit("")).alias("source_url"), first_of(df, ["source", "source_platform"], "").alias("source"), F.coalesce("params_billions", F.lit(0.0)).alias("params_billions"), empty.alias("benchmarks"), F.struct(empty.alias("relations")).alias("mesh_profile")]
    return df.select("id", F.to_json(F.struct(*fields)).alias("bundle"))


def promoted(df: DataFrame) -> DataFrame:
    """df with facts of its JSON text as columns, the first place that has one; language may be a list; a count of 0 stars gives way."""
    at = lambda path: F.get_json_object("meta", path)
    facts = {c: F.coalesce(*(at(p) for p in paths)).try_cast("double") for c, paths in PROMOTED.items()}
    language = F.coalesce(at("$.language[0]"), at("$.language"))
    stars = F.coalesce(F.nullif(F.col("stars").cast("double"), F.lit(0.0)), at("$.stars").try_cast("double"), F.col("stars").cast("double"))
    status = F.coalesce(at("$.runtime_stage"), at("$.runtime.stage"), at("$.running_status"))
    year = F.year(F.try_to_timestamp(at("$.published_date")))
    category = F.coalesce(F.nullif("primary_category", F.lit("")), at("$.primary_category"), at("$.categories[0]"))
    memory = {f"vram_{k}_gb": F.when(F.col("params_billions") > 0, F.round(F.col("params_billions") * x, 1)) for k, x in M.BYTES_PER_PARAM.items()}
    return df.withColumns({**facts, "stars": stars, "primary_language": language, "running_status": status, "published_year": F.when((year > 1990) & (year < 2100), year), "primary_category": category, **memory})


def nested(df: DataFrame) -> DataFrame:
    """(id, entity): an entity in sections, with nulls for what isn't known; the semantic factor is known only in a search."""
    score = F.struct(F.col("score").alias("score"), F.struct(F.lit(None).cast("double").alias("semantic"), F.col("fni_a").alias("authority"), F.col("fni_p").alias("popularity")).alias("factors"))
    specs = F.struct("params_billions", "context_length", F.struct(F.col("vram_gb").alias("estimate_gb")).alias("vram"))
    stats = F.struct("downloads", "stars", "forks", F.col("citations").alias("citation_count"))
    number = F.nullif(F.regexp_extract(F.coalesce("slug", "id"), r"(\d{4}\.\d{4,5})", 1), F.lit(""))
    links = F.struct("source_url", F.when(F.col("type") == "paper", number).alias("arxiv_id"))
    return df.select("id", F.struct("id", "slug", "type", "name", F.nullif("author", F.lit("")).alias("author"), score.alias("fni"), specs.alias("specs"), stats.alias("stats"), links.alias("links")).alias("entity"))


def card(df: DataFrame) -> DataFrame:
    """What a list shows of an entity: at most five tags and 120 characters of its description."""
    return df.select("id", "slug", "name", "type", F.coalesce("author", F.lit("")).alias("author"), F.substring(F.coalesce("description", F.lit("")), 1, 120).alias("description"), F.slice("tags", 1, 5).alias("tags"), F.round("score", 1).alias("score"))


def better(a: Column, b: Column, text: bool = False) -> Column:
    """b where a is empty or, of texts, where b is more than half as long again; else a."""
    empty = a.isNull() | (a.cast("string").isin("", "0", "0.0"))
    good = b.isNotNull() & (b.cast("string") != "")
    longer = F.length(b) > F.length(a) * 1.5 if text else F.lit(False)
    return F.when(good & (empty | F.coalesce(longer, F.lit(False))), b).otherwise(a)


def technical(df: DataFrame) -> DataFrame:
    """(id, params, context, memory, author): facts of an entity, from its columns or else from its name and id."""
    params = F.coalesce(F.nullif("params_billions", F.lit(0.0)), M.params_from_name(first_of(df, *TEXTS["name"])))
    parts = F.split("id", "--")
    raw = F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise(parts[0])
    own = F.col("author")
    good = own.isNotNull() & (own != "") & (own != "Unknown") & ~F.contains(own, F.lit("-"))
    author = F.when(good, own).otherwise(F.initcap(F.regexp_replace(raw, "[-_]", " ")))
    return df.select("id", params.alias("params"), F.col("context_length").alias("context"), F.round(params * M.BYTES_PER_PARAM["fp16"], 1).alias("memory"), author.alias("author"))
