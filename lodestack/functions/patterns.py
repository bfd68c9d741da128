"""Many terms found in a text at once: an automaton over all of them, built once a worker, and one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Terms that are sent to the tasks at most, and their characters.
MOST_TERMS, MOST_CHARS = 1_000_000, 50_000_000

_FOUND = "array<struct<term:int,n:int,words:int>>"
_SPACE = re.compile(r"\s")
_BUILT: dict[int, ahocorasick.Automaton] = {}


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    """Its values are (number of the term, length); equal terms have the last one's number, empty ones are never found."""
    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        if term:
            made.add_word(term, (k, len(term)))
    made.make_automaton()
    return made


def count(found: ahocorasick.Automaton, text: str) -> list[tuple[int, int, int]]:
    """(term, occurrences that don't overlap, words that hold the term) of each term in a text, by number; words are what white space
    parts, so a term with a space in it is in none."""
    seen: dict[int, list[int]] = {}  # of a term: its occurrences, where the last one ended, its words, where the last of these ended
    for last, (k, length) in found.iter(text):
        start = last + 1 - length
        at = seen.setdefault(k, [0, 0, 0, 0])
        if start >= at[1]:
            at[0] += 1
            at[1] = last + 1
        if start >= at[3] and not _SPACE.search(text, start, last + 1):
            end = _SPACE.search(text, last + 1)
            at[2] += 1
            at[3] = end.start() if end else len(text)
    return [(k, n, words) for k, (n, _, words, _) in sorted(seen.items())]


def occurrences(spark: SparkSession, terms: Sequence[str]) -> Callable[[Column], Column]:
    """A function of a text column: array<struct<term, n, words>> of the terms that are in it, by their number in `terms`; see count().

    The terms go to each worker once, by broadcast. Upper and lower case differ; a null text has no terms."""
    if len(terms) > MOST_TERMS or sum(map(len, terms)) > MOST_CHARS:
        raise ValueError(f"more than {MOST_TERMS} terms, or {MOST_CHARS} characters of them")
    sent = spark.sparkContext.broadcast(list(terms)) if terms else None
    if sent is None:
        return lambda text: F.array().cast(_FOUND)

    @F.arrow_udf(_FOUND)
    def each(texts: pa.Array) -> pa.Array:
        if id(sent.value) not in _BUILT:
            _BUILT.clear()
            _BUILT[id(sent.value)] = automaton(sent.value)
        found = _BUILT[id(sent.value)]
        out, ends = [], [0]
        for t in texts:
            if t.is_valid:
                out += count(found, t.as_py())
            ends.append(len(out))
        fields = [pa.array([x[i] for x in out], pa.int32()) for i in range(3)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["term", "n", "words"]))

    return each
