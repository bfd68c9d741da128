"""Which words are within which others: a join by shared character n-grams instead of one by comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The different n-grams of a text; none of a shorter one."""
    n = F.length(text) - size
    return F.array_distinct(F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def contained(words: DataFrame, word: str, texts: DataFrame, text: str, size: int = GRAM) -> DataFrame:
    """(word, text): each different word with each different text that it is in; empty words and nulls are left out.

    A text can only hold a word if it holds the word's rarest n-gram, so each word meets the postings of that one alone and is then
    looked for; a word with an n-gram that no text has meets nothing. Words of fewer than `size` characters are n-grams themselves."""
    parts = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    asked = words.select(word).filter(F.length(word) > 0).distinct()
    postings = parts.select(text, F.explode(grams(F.col(text), size)).alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("df"))
    long = asked.filter(F.length(word) >= size).select(word, F.explode(grams(F.col(word), size)).alias("gram"))
    known = long.join(frequency, "gram", "left").groupBy(word).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("rarest")).filter("rarest.df > 0")
    met = known.select(word, F.col("rarest.gram").alias("gram")).join(postings, "gram").filter(F.contains(F.col(text), F.col(word))).select(word, text)
    short = asked.filter(F.length(word) < size).withColumn("gram", F.col(word))
    pieces = parts.select(text, F.explode(F.concat(*(grams(F.col(text), n) for n in range(1, size)))).alias("gram"))
    return met.unionByName(short.join(pieces, "gram").select(word, text))
