"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing, each stage on all that the last one kept."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import language, nearcopies, packing, quality, substrings
from lodestack.llm.textkit import live, materialise, release, sweep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By run, the tables that its stages so far still had when they returned: their results, which aren't computed yet, read them. Stages
#: that are called one by one are a run by their sf_dir, until the first stage is called for it again.
_LEFT: defaultdict[object, set[str]] = defaultdict(set)
_RUN: ContextVar[object] = ContextVar("run", default=None)


def _tidy(stage: Stage) -> Stage:
    """A stage that first deletes the tables of the stages before it in its own run. By then its docs have been written and reread; what
    docs should still read of them stays. The first stage deletes nothing, and what the last one leaves stays, so that a result
    can be read whatever other runs do."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT[_RUN.get() or sf_dir]
        if stage is not STAGES[0][1].__wrapped__:
            sweep(docs, left)
        left.clear()
        before = live()
        out = stage(spark, docs, sf_dir)
        left.update(live() - before)
        return out

    run.__doc__, run.__name__, run.__wrapped__ = stage.__doc__, stage.__name__, stage
    return run


@_tidy
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, which becomes their lang; those without a letter, or with few n-grams of any, go."""
    return language.keep_known(docs, language.fit(docs))


@_tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms are near those of their language."""
    return quality.keep_good(docs)


@_tidy
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return nearcopies.keep_one(docs, width=5, least=0.8)


@_tidy
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that a document of smaller id has, too."""
    return substrings.dedup_texts(docs)


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("simhash", one_of_near_duplicates),
    ("substrings", without_repeats),
    ("packing", packed),
]

#: Language models, byte-level suffixes and a genetic algorithm are beyond SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The result reads tables in the shared folder; they are its own, and no other run deletes them."""
    docs = table(spark, sf_dir, "documents")
    token = _RUN.set(mark := object())
    try:
        for number, (name, stage) in enumerate(STAGES):
            before, docs = docs, stage(spark, docs, sf_dir)
            if number + 1 < len(STAGES):
                docs = materialise(docs, f"stage_{name}")
                release(before)  # all that reads it has been written
    finally:
        _RUN.reset(token)
        _LEFT.pop(mark, None)
    return docs
