"""Filters: constraints of a selection, a small query language, rules, look-ups by several keys."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences that allow commercial use.
COMMERCIAL = ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "bsl-1.0", "openrail"]
_OPS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "=": operator.eq}


def at_most(column: str, limit: float) -> Column:
    """Unknown and zero pass: they are not known to be too large."""
    c = F.col(column)
    return (c <= limit) | c.isNull() | (c == 0)


def constraints(task: str | None = None, max_vram: float | None = None, max_params: float | None = None, min_context: int | None = None, license: str | None = None, flags: Sequence[str] = ()) -> Column:
    """All given constraints; `commercial` and `any` are licences of their own."""
    out = F.lit(True)
    if task:
        out &= F.col("pipeline_tag") == task
    if max_vram is not None:
        out &= at_most("vram_gb", max_vram)
    if max_params is not None:
        out &= at_most("params_billions", max_params)
    if min_context is not None:
        out &= F.col("context_length") >= min_context
    if license == "commercial":
        out &= F.lower("license").isin(COMMERCIAL)
    elif license and license != "any":
        out &= F.lower("license") == license.lower()
    for f in flags:
        out &= F.col(f)
    return out


def parse(query: str, text: Sequence[str], words: dict[str, str], numbers: dict[str, str]) -> Column:
    """`author:x task:y params:>=7 free words`: contains on `words`, comparison on `numbers`, every free word in one of `text`.

    Quotes keep spaces together; a number that doesn't parse, or an unknown key, counts as a free word."""
    out = F.lit(True)
    hay = F.lower(F.concat_ws(" ", *text))
    for part in re.findall(r'[\w-]+:"[^"]*"|\S+', query):
        key, _, value = part.partition(":")
        value = value.strip('"')
        m = re.fullmatch(r"(>=|<=|>|<|=)?(\d+(?:\.\d+)?)", value)
        if value and key in words:
            out &= F.contains(F.lower(words[key]), F.lit(value.lower()))
        elif m and key in numbers:
            out &= _OPS[m[1] or "="](F.col(numbers[key]), float(m[2]))
        else:
            out &= F.contains(hay, F.lit(part.lower()))
    return out


@dataclass
class Rule:
    """Conditions are (column, op, value) with equals, contains, gt, lt, gte, lte; contains looks into arrays, too."""

    name: str
    conditions: list[tuple[str, str, object]]
    match: str = "AND"
    priority: int = 0
    arrays: frozenset[str] = field(default_factory=frozenset)

    def column(self) -> Column:
        tests = [self._test(*c) for c in self.conditions]
        out = tests[0]
        for t in tests[1:]:
            out = out & t if self.match == "AND" else out | t
        return F.coalesce(out, F.lit(False))

    def _test(self, column: str, op: str, value: object) -> Column:
        c = F.col(column)
        one = {
            "equals": lambda x: x == value,
            "contains": lambda x: F.contains(F.lower(x), F.lit(str(value).lower())),
            "gt": lambda x: x > value,
            "lt": lambda x: x < value,
            "gte": lambda x: x >= value,
            "lte": lambda x: x <= value,
        }[op]
        return F.exists(c, one) if column in self.arrays else one(c)


def first_rules(rules: Sequence[Rule], slots: int = 2, fallback: str = "default") -> Column:
    """Names of the first matching rules by priority, or the fallback."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    hits = F.slice(F.array_compact(F.array(*(F.when(r.column(), F.lit(r.name)) for r in ordered))), 1, slots)
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(fallback)))


def first_hit(wanted: DataFrame, request: str, keys: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """(request, value): that of the first of its keys which the table has, null if none. table has a row per key."""
    each = wanted.select(request, F.posexplode(keys).alias("_pos", key))
    found = each.join(table.select(key, value), key).groupBy(request).agg(F.min_by(value, "_pos").alias(value))
    return wanted.select(request).join(found, request, "left")


def content_status(text: Column, blocked: Sequence[str], doubtful: Sequence[str]) -> Column:
    """blocked, pending or approved, by whole words."""
    pattern = lambda ws: r"\b(?:" + "|".join(map(re.escape, ws)) + r")\b"
    low = F.lower(text)
    return F.when(low.rlike(pattern(blocked)), "blocked").when(low.rlike(pattern(doubtful)), "pending").otherwise("approved")


def harvested(url: str, derived: str) -> Column:
    """An address that a source gave: of eight characters at least, and not the one that follows from the id."""
    return (F.length(url) >= 8) & ~F.coalesce(F.col(url) == F.col(derived), F.lit(False))


def concept_stub(id: str) -> Column:
    """Ids of concepts and articles, which stand for no entity."""
    return F.col(id).rlike("^(?:knowledge|concept|kb|k)--")


def qualified(id: Column, architecture: Column, params: Column, safetensors: Column, gguf: Column) -> Column:
    """Whether an entity is ranked as a model: records of code hosts need an architecture, a size or weights; those of other sources pass."""
    repository = id.startswith("gh-") | id.startswith("github-")
    signal = (F.length(F.coalesce(architecture, F.lit(""))) > 0) | (F.coalesce(params, F.lit(0)) > 0) | F.coalesce(safetensors, F.lit(False)) | F.coalesce(gguf, F.lit(False))
    return ~F.coalesce(repository, F.lit(False)) | signal


def of_page(size: str | None = None, gguf: bool = False, license: str | None = None) -> Column:
    """The choice of a category page over params_billions, tags, library_name and license: small is under 7 (unknown sizes, too), medium 7 to 13,
    any other size over 70; licences are commercial or else open, by words in them."""
    out, params = F.lit(True), F.coalesce("params_billions", F.lit(0))
    if size:
        out &= params < 7 if size == "small" else params.between(7, 13) if size == "medium" else params > 70
    if gguf:
        out &= F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit("gguf"))) | (F.coalesce("library_name", F.lit("")) == "gguf")
    if license:
        words = ["mit", "apache"] if license == "commercial" else ["mit", "gpl"]
        low = F.lower(F.coalesce("license", F.lit("")))
        out &= F.contains(low, F.lit(words[0])) | F.contains(low, F.lit(words[1]))
    return out
