"""Canonical ids, as column expressions over tables of prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefix of each source and type.
PREFIXES = {
    "hf": {"model": "hf-model--", "dataset": "hf-dataset--", "space": "hf-space--", "agent": "hf-agent--", "paper": "hf-paper--", "collection": "hf-collection--", "tool": "hf-tool--"},
    "gh": {"agent": "gh-agent--", "tool": "gh-tool--", "model": "gh-model--", "repo": "gh-repo--"},
    "arxiv": {"paper": "arxiv-paper--"},
    "civitai": {"model": "civitai-model--"},
    "kaggle": {"dataset": "kaggle-dataset--", "model": "kaggle-model--"},
    "replicate": {"model": "replicate-model--"},
    "ollama": {"model": "ollama-model--"},
    "mcp": {"agent": "mcp-server--", "tool": "mcp-tool--"},
    "langchain": {"prompt": "langchain-prompt--", "agent": "langchain-agent--"},
    "knowledge": {"concept": "knowledge--"},
    "report": {"weekly": "report--"},
    "openllm": {"benchmark": "benchmark--"},
}
# Prefixes that tell a source or a type only.
PARTIAL = {"hf--": ("hf", None), "gh--": ("gh", None), "replicate--": ("replicate", None), "civitai--": ("civitai", None), "kaggle--": ("kaggle", None), "ollama--": ("ollama", None), "dataset--": (None, "dataset"), "space--": (None, "space"), "agent--": (None, "agent"), "tool--": (None, "tool"), "paper--": (None, "paper"), "prompt--": (None, "prompt")}
ALIASES = {"huggingface": "hf", "hf_hub": "hf", "github": "gh", "gh_repo": "gh", "mcp_registry": "mcp", "langchain_hub": "langchain"}
# File endings that are no part of an id, each taken off once in this order.
ENDS = [r"\.meta\.json", r"\.meta", r"\.md", r"\.json"]
#: Where an id comes from, if nothing else tells.
SITES = {"github.com": "gh", "huggingface.co": "hf", "arxiv.org": "arxiv"}
DEFAULT_SOURCE = "hf"
DEFAULT_TYPE = {"arxiv": "paper", "gh": "agent", "langchain": "prompt"}

# What may lead an id before two dashes, a colon or a slash, and is left out where two ids are compared.
LEADING = [
    "hf-model", "hf-agent", "hf-tool", "hf-dataset", "hf-space", "hf-paper", "hf-collection", "gh-model", "gh-agent", "gh-tool", "gh-repo",
    "arxiv-paper", "arxiv", "paper", "replicate-model", "replicate-agent", "replicate-space", "civitai-model", "ollama-model",
    "kaggle-dataset", "kaggle-model", "langchain-prompt", "langchain-agent", "benchmark", "knowledge", "concept", "report", "dataset",
    "model", "agent", "tool", "space", "prompt",
]

_WHOLE = {p: (s, t) for s, by in PREFIXES.items() for t, p in by.items()}
_ANY_WHOLE, _ANY_PART = (f"(?:{'|'.join(x)})" for x in (_WHOLE, PARTIAL))


def _look_up(table: dict[str, str | None], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() if v is not None for x in (k, v))), key)


def _given(column: Column) -> Column:
    return F.nullif(F.lower(column), F.lit(""))


def canonical(id: Column, source: Column, type: Column) -> Column:
    """The id with the prefix of its source and type; null for an empty one.

    What leads an id are up to five known prefixes; one that tells only a source or a type is the last of them, as what follows may
    be a name. A source or type that isn't given is that of the last prefix which tells it, or else a usual one."""
    plain = F.lower(id)
    for end in ENDS:
        plain = F.regexp_replace(plain, end + r"\z", "")
    plain = F.trim(F.regexp_replace(plain, "[/:]", "--"))
    plain = F.regexp_replace(plain, r"(\d{4}\.\d{4,5})v\d+\z", "$1")
    lead = F.regexp_extract(plain, f"^((?:{_ANY_WHOLE}){{0,4}}(?:{_ANY_WHOLE}|{_ANY_PART})?)", 1)
    last = F.regexp_extract(lead, f"({_ANY_WHOLE}|{_ANY_PART})$", 1)
    whole = F.regexp_extract(lead, f"({_ANY_WHOLE})(?:{_ANY_PART})?$", 1)
    tells = lambda k: F.coalesce(_look_up({p: x[k] for p, x in (_WHOLE | PARTIAL).items()}, last), _look_up({p: x[k] for p, x in _WHOLE.items()}, whole))
    named = F.coalesce(_given(source), tells(0))
    by_site = F.coalesce(*(F.when(id.contains(site), s) for site, s in SITES.items()), F.lit(DEFAULT_SOURCE))
    of_source = F.coalesce(_look_up(ALIASES, named), named, by_site)
    tool = (of_source == "gh") & F.lower(id).rlike("tool|mcp|plugin")
    usual = F.when(tool, "tool").otherwise(F.coalesce(_look_up(DEFAULT_TYPE, of_source), F.lit("model")))
    of_type = F.coalesce(_given(type), tells(1), usual)
    prefix = _look_up({f"{s} {t}": p for p, (s, t) in _WHOLE.items()}, F.concat_ws(" ", of_source, of_type))
    return F.when(id != "", F.concat(F.coalesce(prefix, F.lit("")), F.substring(plain, F.length(lead) + 1, F.length(plain))))


def stripped(id: Column) -> Column:
    """An id as it is compared with others: lower case, without what leads it, its parts between two dashes; null if nothing is left."""
    low = F.lower(id)
    rest = F.regexp_replace(low, f"^(?:{'|'.join(LEADING)})(?:--|:|/)", "")
    ends = F.regexp_replace(F.regexp_replace(rest, "[:/]", "--"), r"^--|--\z", "")
    # most ids have nothing to strip or part, and a look for that costs less than four patterns
    parted = F.contains(low, F.lit("--")) | F.contains(low, F.lit(":")) | F.contains(low, F.lit("/"))
    return F.nullif(F.when(parted, F.regexp_replace(ends, "-{2,}", "--")).otherwise(low), F.lit(""))
