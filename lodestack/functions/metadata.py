"""Facts derived from an entity's metadata: licence class, architecture, parameters, categories, memory, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, tried in this order.
PERMISSIVE = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "wtfpl", "zlib", "bsl-1.0", "openrail"]
COPYLEFT = ["gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0"]
NON_COMMERCIAL = ["cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "llama2", "llama 2", "creativeml-openrail-m"]
ARCHITECTURES = [
    "llama3", "llama2", "llama", "mixtral", "mistral", "qwen3", "qwen2", "qwen", "gemma2", "gemma", "phi3", "phi2", "phi",
    "deepseek-v2", "deepseek-v3", "deepseek", "baichuan2", "baichuan", "yi-34b", "yi-6b", "yi", "falcon", "gpt-neox", "gpt-j",
    "gpt2", "gpt", "roberta", "bert", "distilbert", "electra", "albert", "deberta-v3", "deberta-v2", "deberta", "t5-v1.1", "t5",
    "mt5", "bart", "pegasus", "vit", "clip", "sam", "beit", "whisper", "wav2vec2", "llava", "flamingo",
]
QUANT_FACTOR = {"fp16": 2.0, "bf16": 2.0, "q8": 1.1, "q6": 0.9, "q5": 0.82, "q4": 0.75, "q3": 0.6, "q2": 0.4}
BYTES_PER_PARAM = {"fp16": 2.2, "int8": 1.2, "int4": 0.7}


def any_of(column: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | column.contains(n)
    return out


def license_class(raw: Column) -> Column:
    """By the first list that holds a part of the text, so that `limited` counts as `mit`."""
    text = F.lower(F.trim(raw))
    return F.when(raw.isNull() | (raw == ""), "unknown").when(any_of(text, PERMISSIVE), "permissive").when(any_of(text, COPYLEFT), "copyleft").when(any_of(text, NON_COMMERCIAL), "non-commercial").otherwise("unknown")


def architecture(tags: Column) -> Column:
    """The first architecture that is a tag or else a part of one; null if none is."""
    known, low = F.array(*map(F.lit, ARCHITECTURES)), F.transform(tags, F.lower)
    exact = F.get(F.filter(known, lambda a: F.array_contains(low, a)), F.lit(0))
    part = F.get(F.filter(known, lambda a: F.exists(low, lambda t: F.contains(t, a))), F.lit(0))
    return F.coalesce(exact, part)


def params_from_name(name: Column) -> Column:
    """Billions of parameters as in `7B` or `0.5b`, from 0.1 to 2000."""
    found = F.regexp_extract(name, r"(\d+(?:\.\d+)?)\s*[Bb](?![a-zA-Z])", 1).try_cast("double")
    return F.when(found.between(0.1, 2000), found)


def vram_gb(params: Column, precision: str = "fp16") -> Column:
    return params * BYTES_PER_PARAM[precision]


def vram_with_context(params: Column, quant: str, context: Column, mixture: Column) -> Column:
    """Weights by quantisation, a cache allowance by context and size, runtime, and router padding for mixtures; one decimal."""
    cache = lambda small, big: F.when(params > 30, big).otherwise(small)
    kv = F.when(context <= 8192, cache(0.8, 2.0)).when(context <= 32768, cache(2.0, 5.0)).otherwise(cache(4.0, 12.0))
    total = params * QUANT_FACTOR.get(quant.lower(), QUANT_FACTOR["q4"]) + kv + 0.5 + F.when(mixture, 0.2).otherwise(0.0)
    return F.when(params > 0, F.floor(total * 10 + 0.5) / 10).otherwise(0.0)


def activity(days: Column) -> Column:
    return F.when(days <= 30, "active").when(days <= 90, "maintained").when(days <= 365, "stable").when(days.isNotNull(), "legacy")


def size_bucket(params: Column) -> Column:
    return F.when(params.isNull(), "unknown").when(params < 7, "small").when(params <= 13, "medium").when(params > 70, "huge").otherwise("large")


def category(primary: Column, pipeline: Column, mapping: dict[str, str], name: Column, patterns: dict[str, str], default: str) -> Column:
    """The primary category, or that of the pipeline, or of the first pattern the name matches, or the default."""
    by_pipeline = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[pipeline]
    by_name = F.lit(None).cast("string")
    for pattern, value in reversed(list(patterns.items())):
        by_name = F.when(F.lower(name).rlike(pattern), value).otherwise(by_name)
    return F.coalesce(primary, by_pipeline, by_name, F.lit(default))


def task_tags(tags: Column, mapping: dict[str, str], name: Column, patterns: dict[str, str]) -> Column:
    """Tasks of tags and name, each once, in order."""
    lookup = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    of_name = F.array_compact(F.array(*(F.when(F.lower(name).rlike(p), v) for p, v in patterns.items())))
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.transform(tags, lambda t: F.try_element_at(lookup, F.lower(t))), lambda x: x.isNotNull()), of_name)))


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-case tags of 1 to 49 characters."""
    return F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: F.length(t).between(1, 49))


def compact_number(n: Column) -> Column:
    """1500 as 1.5K, 2000000 as 2.0M; below a thousand as it is."""
    tenth = lambda x: F.format_number(F.floor(x * 10 + 0.5) / 10, 1)
    return F.when(n >= 1_000_000, F.concat(tenth(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenth(n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def badge_colour(score: Column) -> Column:
    return F.when(score >= 90, "#4c1").when(score >= 70, "#08c").when(score >= 50, "#dfb317").otherwise("#e05d44")


def badge_label(score: Column) -> Column:
    return F.when(score >= 90, "High signal").when(score >= 70, "Medium signal").when(score >= 50, "Low signal").otherwise("Insufficient signal")


def sitemap_priority(score: Column) -> Column:
    return F.when(score.isNull() | (score <= 0), "0.3").when(score >= 80, "0.9").when(score >= 60, "0.8").when(score >= 40, "0.7").when(score >= 20, "0.5").otherwise("0.4")


def source_url(id: Column, author: Column, name: Column) -> Column:
    """Where an entity lives: by author and name if both are known, else by the parts of its id."""
    out = F.lit(None).cast("string")
    for prefix, site in (("replicate-", "https://replicate.com/"), ("gh-", "https://github.com/"), ("hf-", "https://huggingface.co/")):
        parts = F.regexp_extract(id, "^" + prefix + "[a-z]+--([^-].*?)--(.+)$", 1), F.regexp_extract(id, "^" + prefix + "[a-z]+--([^-].*?)--(.+)$", 2)
        by_id = F.when(parts[1] != "", F.concat(F.lit(site), parts[0], F.lit("/"), parts[1]))
        out = F.when(id.startswith(prefix), F.coalesce(F.concat(F.lit(site), author, F.lit("/"), name), by_id)).otherwise(out)
    paper = F.regexp_extract(id, "^arxiv-[a-z]+--[^-].*?--(.+)$", 1)
    local = F.regexp_extract(id, "^ollama-model--(.+)$", 1)
    return F.when(paper != "", F.concat(F.lit("https://arxiv.org/abs/"), paper)).when(local != "", F.concat(F.lit("https://ollama.com/library/"), local)).otherwise(out)


def arxiv_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b"), 1))


def iso_week(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.extract(F.lit("WEEK"), day))


def bibtex(id: Column, title: Column, author: Column, year: Column, url: Column) -> Column:
    """A citation entry; null for titles that are missing, ids or hashes."""
    poor = title.isNull() | (F.trim(title) == "") | title.rlike("^[0-9a-f]{16,}$") | title.contains("--") | F.lower(title).isin("untitled", "unknown")
    entry = F.concat(F.lit("@misc{"), F.regexp_replace(id, "[^A-Za-z0-9]+", "_"), F.lit(", title={"), title, F.lit("}, author={"), F.coalesce(author, F.lit("Unknown")), F.lit("}, year={"), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("}, url={"), F.coalesce(url, F.lit("")), F.lit("}}"))
    return F.when(~poor, entry)


def citation(id: Column, title: Column, ids: Sequence[Column], author: Column, year: Column, url: Column, own_site: str | None = None, note: str | None = None) -> Column:
    """A citation entry of what is known and nothing else; null for a title that is missing, a placeholder, a hash, or one of the ids.

    Years from 1991 to 2099 count, and addresses of other sites than own_site."""
    name, place, who = F.trim(title), F.trim(url), F.trim(author)
    poor = F.coalesce(name == "", F.lit(True)) | name.rlike(r"(?i)^(unknown|untitled|n/?a|none|null|undefined|[0-9a-f]{16,})$")
    for other in ids:
        poor = poor | F.coalesce(name == F.trim(other), F.lit(False))
    outside = place.rlike("(?i)^https?://") if own_site is None else place.rlike("(?i)^https?://") & ~F.contains(F.lower(place), F.lit(own_site.lower()))
    key = F.substring(F.regexp_replace(F.coalesce(F.nullif(F.trim(id), F.lit("")), name), "[^a-zA-Z0-9]", "_"), 1, 40)
    field = lambda label, value: F.concat(F.lit(label + "={"), value, F.lit("}"))
    fields = [field("title", name), F.when(who != "", field("author", who)), F.when((year > 1990) & (year < 2100) & (year == F.floor(year)), field("year", year.cast("int").cast("string"))), F.when(outside, field("url", place))]
    if note is not None:
        fields.append(field("note", F.lit(note)))
    return F.when(~poor, F.concat(F.lit("@misc{"), key, F.lit(","), F.concat_ws(",", *fields), F.lit("}")))


def status_class(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status < 500, "client_error").otherwise("server_error")


def referer_class(url: Column) -> Column:
    """Where a request came from, by the host of its referer."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(host == "", "direct").when(host.rlike(r"(^|\.)(google|bing|duckduckgo)\."), "search").when(host.rlike(r"(^|\.)(github\.com|huggingface\.co)$"), "developer").otherwise("other")


def audience(agent: Column) -> Column:
    """Whether a client says that it is a program."""
    return F.when(F.lower(F.coalesce(agent, F.lit(""))).rlike("bot|crawler|spider|gpt|curl|python"), "agent").otherwise("human")
