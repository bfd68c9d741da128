"""The checker's own views, as DuckDB SQL to put before a query."""

from __future__ import annotations

from lodestack.functions import text as X
from lodestack.sources.catalogue import ADDED_COLUMNS, ENTITY_COLUMNS, HISTORY_SQL, RAW_COLUMNS, RELATION_COLUMNS, TAGS

ENT = "ent AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ENTITY_COLUMNS.items()) + f", [{', '.join(TAGS)}] AS tags FROM part)"
RAW = "raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RAW_COLUMNS.items()) + ", tags FROM ent)"
FULL = "full_records AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in ADDED_COLUMNS.items()) + " FROM raw)"
REL = "rel AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RELATION_COLUMNS.items()) + " FROM lineitem)"
HIST = f"hist AS ({HISTORY_SQL})"


def given(sql: str, *views: str) -> str:
    """A query with views before it; `sql` may start with more views, named, and then SELECT."""
    return "WITH " + ", ".join(views) + (", " if not sql.lstrip().upper().startswith("SELECT") else " ") + sql


def cases(expression: str, table: dict[str, object], default: str = "NULL") -> str:
    """CASE by equality, for a table of literals."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def first_match(expression: str, patterns: dict[str, str], default: str = "NULL") -> str:
    """The name of the first pattern that is found."""
    return "CASE " + " ".join(f"WHEN regexp_matches({expression}, '{p}') THEN '{name}'" for name, p in patterns.items()) + f" ELSE {default} END"


def stems(words: str) -> str:
    """The distinct stems of a list of words."""
    swap = lambda table: f"lambda w: CASE WHEN regexp_extract(w, '({'|'.join(table)})$', 1) = '' THEN w ELSE left(w, length(w) - length(regexp_extract(w, '({'|'.join(table)})$', 1))) || {cases(f'regexp_extract(w, ' + repr('(' + '|'.join(table) + ')$') + ', 1)', table)} END"
    out = f"list_distinct({words})"
    out = f"list_transform({out}, lambda w: CASE WHEN regexp_matches(w, '^..+ies$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'sses$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '^..+[^s]s$') THEN left(w, length(w) - 1) ELSE w END)"
    out = f"list_transform({out}, lambda w: CASE WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) > 4 THEN left(w, length(w) - 1) ELSE w END WHEN regexp_matches(w, '[aeiou].*ed$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '[aeiou].*ing$') THEN left(w, length(w) - 3) ELSE w END)"
    out = f"list_transform({out}, lambda w: CASE WHEN regexp_matches(w, '.[^aeiou]y$') THEN left(w, length(w) - 1) || 'i' ELSE w END)"
    out = f"list_transform(list_transform({out}, {swap(X.DERIVED)}), {swap(X.FORMED)})"
    ends = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) > {len(e) + 1} THEN left(w, length(w) - {len(e)})" for e in ("ement", "ment", "ent", "ant", "ence", "ance", "ible", "able"))
    out = f"list_transform({out}, lambda w: CASE {ends} WHEN regexp_matches(w, '.[st]ion$') THEN left(w, length(w) - 3) WHEN regexp_matches(w, '^..+(er|ou)$') THEN left(w, length(w) - 2) ELSE w END)"
    out = f"list_transform({out}, lambda w: CASE WHEN ends_with(w, 'll') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)"
    return f"list_filter(list_distinct({out}), lambda w: length(w) BETWEEN 2 AND 40)"


def words(text: str) -> str:
    """The words of a text that are no stop words; repeats stay."""
    listed = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_filter(string_split_regex(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) BETWEEN 2 AND 40 AND NOT list_contains([{listed}], w))"
