"""Operator 11, document fingerprints [native]: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle of WIDTH words is hashed once; the upper eight bits of the hash name one of 256 bins, and a bin keeps its smallest
hash. An empty bin takes the value of the first filled bin among its own probes, which are drawn from a rule and are the same for
all documents; where all probes are empty, of the filled bin that has the smallest hash together with its number. Either way each
filled bin is as likely as any other, whatever the other empty bins take. Of each bin the low four bits are stored: 256 bins
in 16 longs, or a hexadecimal digit a bin. Two values agree by chance once in 16, which `likeness` takes out.

All is done in arrays of the row by DataFrame functions. Documents are neither exploded nor compared in pairs.
"""

from __future__ import annotations

import math
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm.textkit import table

WIDTH = 5
BINS = 256
BITS = 4
#: Probes of an empty bin before all filled bins are looked at.
PROBES = 12
#: Documents of a range, and the greatest number of ranges.
RANGE_ROWS = 8192
MOST_RANGES = 1 << 16

_SHIFT = 56
_NONE = (1 << _SHIFT) - 1
_LOWEST = -(1 << 63)
_A_WORD = 64 // BITS
_SPACE = " \t\n\x0b\f\r"


def _longs(values: list[int]) -> Column:
    """A constant array; a literal for each of its elements would make the plan slow to build."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


#: The largest value of each bin, in order. It stands for an empty one, and gives every bin an entry among the sorted hashes.
_ENDS = [((b - BINS // 2) << _SHIFT) | _NONE for b in range(BINS)]


def probes(b: int) -> list[int]:
    """The bins that bin b, if empty, looks at."""
    return [xxhash.xxh64_intdigest(f"{b}:{t}") % BINS for t in range(PROBES)]


def with_fingerprint(docs: DataFrame, text: str, name: str, width: int = WIDTH) -> DataFrame:
    """docs with the fingerprint of the column `text` in a new last column, an array of 16 longs.

    Words are runs of bytes other than white space, in lower case. A text of fewer words than `width` is one shingle of all of them;
    so null, empty and white-space texts have the one empty shingle and equal fingerprints. Equal texts have equal fingerprints. Repeated rows give
    repeated results, an empty table none; other columns may have any name. A row's arrays take some fifty bytes a word."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    trimmed = F.btrim(plain, F.lit(_SPACE))
    cut = docs.select(F.struct("*").alias("whole"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"))
    words, n = F.col("words"), F.size("words")
    shingles = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    hashes = F.when(n >= width, shingles).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))
    ordered = cut.select("whole", F.sort_array(F.concat(hashes, _longs(_ENDS))).alias("ordered"))
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    least = ordered.select("whole", F.filter("ordered", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("ordered", i - 1)))).alias("bins"))
    known = least.select("whole", F.transform("bins", lambda x: F.when(x.bitwiseAND(F.lit(_NONE)) != _NONE, x)).alias("bins"))
    full = known.select("whole", "bins", F.filter("bins", lambda x: x.isNotNull()).alias("full"))
    table_of_probes = _longs([j for b in range(BINS) for j in probes(b)])

    def value(x: Column, i: Column) -> Column:
        probed = (F.get("bins", F.get(table_of_probes, i * PROBES + t).cast("int")) for t in range(PROBES))
        other = F.array_min(F.transform("full", lambda y: F.struct(F.xxhash64(i, bin_of(y)).alias("order"), y.alias("y"))))["y"]
        return F.coalesce(x, *probed, other).bitwiseAND(F.lit((1 << BITS) - 1))

    low = full.select("whole", F.transform("bins", value).alias("low"))
    pack = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(_A_WORD - 1)), F.lit(0).cast("long"), lambda a, k: F.shiftleft(a, BITS).bitwiseOR(F.get("low", w * _A_WORD + k)))
    # the size makes two uses of `low`, so that it stays a column and isn't made anew for each element
    packed = low.select("whole", F.transform(F.sequence(F.lit(0), (F.size("low") / _A_WORD).cast("int") - 1), pack).alias("packed"))
    return packed.select("whole.*", F.col("packed").alias(name))


def digits(packed: Column) -> Column:
    """A fingerprint as 256 lower-case hexadecimal digits."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), _A_WORD, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two texts' shingles by their fingerprints, from 0 to 1: the share of bins that agree, less what agrees by
    chance. Its standard error is 0.033 at most for texts with many shingles."""
    ones = F.lit(sum(1 << BITS * k for k in range(_A_WORD)))

    def differ(x: Column) -> Column:
        for k in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, x: s + differ(x))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - apart / BINS - chance) / (1 - chance))


def followed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs(doc_id, text, ...), with next_<column> of the document that follows by descending doc_id; after the last comes the first.

    Null ids come last. Documents of one id follow by a hash of their text, so that equal ones are neighbours. A single
    document follows itself, and an empty table gives none. The texts are exchanged once: ranges of ids, whose bounds are
    quantiles, are dealt out whole, and the first document of each is sent to the range before as well. An id with many
    documents is cut by the hash into as many ranges as it fills."""
    spark = docs.sparkSession
    tag = uuid.uuid4().hex[:8]
    nk, u, part, last, place = (f"{c}_{tag}" for c in ("nk", "u", "part", "last", "place"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    rows = docs.count()
    ranges = min(MOST_RANGES, max(rows // RANGE_ROWS, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 16)), rows) or 1
    shares = F.split(F.lit(",".join(str(k / ranges) for k in range(1, ranges)) or "0.5"), ",").cast("array<double>")
    bounds = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * ranges)).alias("b")).first()["b"] or []
    bounds = sorted(bounds if ranges > 1 else [], reverse=True)  # at most MOST_RANGES numbers
    step = max(1, math.isqrt(len(bounds)))

    def counted(over) -> Column:
        """How many bounds are over the key."""
        if not bounds:
            return F.lit(0)
        g = F.size(F.filter(_longs(bounds[::step]), over))
        return F.when(g == 0, 0).otherwise((g - 1) * step + F.size(F.filter(F.slice(_longs(bounds), F.greatest(g - 1, F.lit(0)) * step + 1, F.lit(step)), over)))

    above, upto = counted(lambda b: b > key), counted(lambda b: b >= key)
    at = F.shiftrightunsigned(F.xxhash64("text"), 11)  # 53 bits
    dealt = docs.withColumn(nk, F.bitwise_not(key)).withColumn(u, at).withColumn(part, (above + F.floor((upto - above + 1) * (F.col(u) * 2.0**-53))).cast("int"))
    order = F.struct(F.col(nk).alias("nk"), F.col(u).alias("u"))
    firsts = dealt.groupBy(F.col(part).alias("part")).agg(F.min(order).alias("least"))  # a row a range
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("least.nk").alias(nk), F.col("least.u").alias(u), before.alias(last))
    places = F.when(F.col(last).isNull(), F.array(F.struct(F.col(part).alias("part"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(F.col(part).alias("part"), F.lit(0).alias("copy")), F.struct(F.col(last).alias("part"), F.lit(1).alias("copy"))))
    sent = dealt.join(F.broadcast(firsts), [nk, u], "left").withColumn(place, F.explode(places)).withColumn(part, F.col(f"{place}.part")).withColumn(last, F.col(f"{place}.copy"))
    w = Window.partitionBy(part).orderBy(last, nk, u)
    return sent.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).filter(F.col(last) == 0).drop(nk, u, part, last, place)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs(doc_id, text).

    The edited text has its last third replaced by the beginning, of as many code points or all, of the document that follows it (see
    followed). A null text is empty; repeated rows give repeated results."""
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp")
    both = followed(own, ["text", "fp"]).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third))
    done = with_fingerprint(both.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited")), "edited", "edited_fp")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("fp")).alias("fingerprint"),
        digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
