"""Operator 3, quality rules [native]: Jensen-Shannon divergence of a text's histograms from those of its language.

Two histograms are compared: characters by class, and words by common word of the language (all other words are one more bin).
The references are those of the corpus itself: the sums over all documents of a language that pass the base rules and have
less than one symbol in ten words. Documents
whose language has no word list are compared with all documents of that kind. Short texts have ragged histograms, so each
comparison counts only from a minimum length on. Everything is a DataFrame expression; the per-word work is done in arrays of
the row, so no text and no word is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.textkit import materialise, table

#: Common words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "für", "auf", "sich", "auch"],
    "en": ["the", "and", "of", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "this", "are"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "du", "en"],
}
OTHER = "other"
CLASSES = ["lower", "upper", "digit", "space", "punct", "symbol", "rest"]
MIN_CHARS = 200
MIN_WORDS = 100
MAX_CLASS_JSD = 0.2
MAX_WORD_JSD = 0.33


#: The characters that count as symbols.
_SYMBOLS = "#*$%&|<>"
_LOW31 = (1 << 31) - 1


def _language(docs: DataFrame) -> Column:
    return F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(F.lit(OTHER)) if "lang" in docs.columns else F.lit(OTHER)


def _window(words: Column, x: Column) -> Column:
    """The three words of a packed window, and its position."""
    at = x.bitwiseAND(F.lit(_LOW31))
    return F.struct(*(F.get(words, (at + k).cast("int")).alias(f"w{k}") for k in range(3)), at.alias("at"))


def _covered(ordered: Column) -> Column:
    """Words that lie in a window which the sorted array of windows has twice or more. An array that is looked into from within
    a lambda must be a column, else it is made anew for each element."""
    same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    found = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)))
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))))


def features(docs: DataFrame, key: list[str]) -> DataFrame:
    """The key columns of docs(text, lang if there), the language of the reference, the base figures and both histograms."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*key, _language(docs).alias("ref"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    base = base.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    words, n = F.col("words"), F.size("words")
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("long")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    common = sorted({w for v in COMMON_WORDS.values() for w in v})
    one = base.select(
        *key,
        "ref",
        "text",
        "words",
        F.regexp_replace("text", r"\p{L}+", "").alias("signs"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("upper"),
        F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        lines.alias("lines"),
        # each between two spaces, so that whole words can be counted by what taking them out leaves
        F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", F.lower), lambda w: w.isin(common)), "  "), F.lit(" ")).alias("common"),
    )
    hits = F.filter("windows", lambda x, i: (F.shiftright(x, 31) == F.shiftright(F.get("windows", i - 1), 31)) | (F.shiftright(x, 31) == F.shiftright(F.get("windows", i + 1), 31)))
    two = one.select(*key, "ref", "words", "upper", "lines", "common", "signs", F.length("text").alias("n_chars"), hits.alias("hits"))
    # hashes only choose the windows to look at: these are grouped by their words
    two = two.withColumn("doubtful", F.sort_array(F.transform("hits", lambda x: _window(F.col("words"), x)))).drop("hits")
    left = lambda column, pattern: F.length(F.regexp_replace(column, pattern, "")).cast("long")
    letters = F.col("n_chars") - F.length("signs")
    count = lambda w: ((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    by_word = F.array().cast("array<bigint>")
    for lang, listed in sorted(COMMON_WORDS.items()):
        by_word = F.when(F.col("ref") == lang, F.array(*(count(w) for w in listed))).otherwise(by_word)
    three = two.select(
        *key,
        "ref",
        "n_chars",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        left("signs", f"[^{_SYMBOLS}]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("doubtful") > 0, _covered(F.col("doubtful"))).otherwise(0).cast("long").alias("n_repeat_words"),
        (letters - F.col("upper")).cast("long").alias("lower"),
        F.col("upper").cast("long").alias("upper"),
        left("signs", r"[^0-9]+").alias("digit"),
        left("signs", r"[^\x20\x09-\x0D]+").alias("space"),
        left("signs", r"[^.,;:!?'\"()-]+").alias("punct"),
        by_word.alias("by_word"),
    )
    known = F.col("lower") + F.col("upper") + F.col("digit") + F.col("space") + F.col("punct") + F.col("n_symbols")
    return three.select(
        *key,
        "ref",
        "n_chars",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array("lower", "upper", "digit", "space", "punct", "n_symbols", F.col("n_chars") - known).alias("classes"),
        F.concat("by_word", F.array(F.col("n_words") - F.aggregate("by_word", F.lit(0).cast("long"), lambda a, x: a + x))).alias("word_hist"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of counts of one length; null if either has no counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)  # noqa: E731, short arrays
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: F.struct((x / total(p)).alias("x"), (y / total(q)).alias("y")))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, t: s + 0.5 * (part(t["x"], (t["x"] + t["y"]) / 2) + part(t["y"], (t["x"] + t["y"]) / 2)))
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(docs: DataFrame, key: list[str], min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_class: float = MAX_CLASS_JSD, max_word: float = MAX_WORD_JSD) -> DataFrame:
    """features() with both distances, null below the minimum lengths or without a reference, and the verdict `kept`."""
    found = materialise(features(docs, key), "features")
    sums = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n)))
    wide = max(map(len, COMMON_WORDS.values())) + 1
    reference = found.filter(~F.col("base_failed") & (10 * F.col("n_symbols") < F.col("n_words"))).groupBy("ref").agg(sums("classes", len(CLASSES)).alias("ref_classes"), F.filter(sums("word_hist", wide), lambda x: x.isNotNull()).alias("ref_words"))
    both = found.join(F.broadcast(reference), "ref", "left")  # a row per word list, and one for other languages
    both = both.withColumn("class_jsd", F.when(F.col("n_chars") >= min_chars, distance(F.col("classes"), F.col("ref_classes")))).withColumn("word_jsd", F.when(F.col("n_words") >= min_words, distance(F.col("word_hist"), F.col("ref_words"))))
    odd = (F.coalesce("class_jsd", F.lit(0.0)) > max_class) | (F.coalesce("word_jsd", F.lit(0.0)) > max_word)
    return both.withColumn("kept", ~F.col("base_failed") & ~odd)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, both distances and the verdict for every row of docs(doc_id, text, lang if there).

    A null, empty or white-space text has no words and fails the base rules. A null or unlisted lang is compared with all documents
    of that kind. Repeated rows give repeated results; an empty table gives none; only doc_id, text and lang are read, so other
    columns may have any name; a text exactly at a threshold is kept."""
    return judged(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_jsd", 6).alias("class_jsd"), F.round("word_jsd", 6).alias("word_jsd"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are kept; each row is judged by itself, and travels with its figures, so nothing is joined back."""
    whole = docs.select("text", *(["lang"] if "lang" in docs.columns else []), F.struct("*").alias("whole"))
    return judged(whole, ["whole"]).filter("kept").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
