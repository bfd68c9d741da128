"""Vectors in array columns: distance, similarity, quantisation, set overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def quantise(a: Column) -> Column:
    """Signed bytes of the values times 127, halves upward."""
    return F.transform(a, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def packed_bytes(a: Column) -> Column:
    """The signed bytes of quantise() as base64 text."""
    return F.base64(F.unhex(F.array_join(F.transform(quantise(a), lambda x: F.lpad(F.hex((x.cast("int") + 256) % 256), 2, "0")), "")))


def unpacked_bytes(text: Column) -> Column:
    digits = F.hex(F.unbase64(text))
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda k: F.when(byte(k) > 127, byte(k) - 256).otherwise(byte(k)))


def byte_cosine(a: Column, text: Column) -> Column:
    """Cosine of a vector and one in packed bytes; -1 where the latter has no length."""
    b = unpacked_bytes(text)
    return F.when(dot(b, b) == 0, -1.0).otherwise(cosine(a, b))
