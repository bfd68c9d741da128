"""Writing tables: epochs with retention, slots, pages, lines of JSON; and reading them back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder where driver and executors both write: the checkpoint folder of the session or its context, or a temporary one in
    local mode; on a cluster without either it raises."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (None if folder.isEmpty() else folder.get())
    if base is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestack-")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def write_epoch(df: DataFrame, path: str, epoch: str, keep: int = 5) -> None:
    """A complete copy under epoch=..., and the oldest epochs beyond `keep` removed; readers of one epoch never see half of another."""
    df.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/epoch={epoch}")
    fs, root = _fs(df.sparkSession, path)
    for old in _epochs(fs, root)[:-keep]:
        fs.delete(old, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    fs, root = _fs(spark, path)
    return spark.read.parquet(_epochs(fs, root)[-1].toString())


def _fs(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _epochs(fs, root) -> list:
    """The folders of epochs, the oldest first: by the numbers in their names, then by name."""
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("epoch=")]
    return sorted(found, key=lambda p: ([int(n) for n in re.findall(r"\d+", p.getName())], p.getName()))


def write_slots(df: DataFrame, path: str, digest: Column, slots: int) -> None:
    """Partitioned by a slot of a hex digest; rows of a slot meet before they are written, so a slot has few files."""
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")
    df.withColumn("slot", slot).repartition("slot").write.partitionBy("slot").mode("overwrite").parquet(path)


def write_ndjson(df: DataFrame, path: str, rows: int) -> None:
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a fixed schema, and the lines that don't have it."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_corrupt"), parsed.filter(bad).select("value")


def numbered_pages(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """df with `page`, the number of a row's page of `size` rows within its group; groups are numbered by ranges, so a large one is no single task's."""
    rows = numbered(df, [*(F.asc(g) for g in group), *order], "_row")
    starts = rows.groupBy(*group).agg(F.min("_row").alias("_start")).select(*(F.col(g).alias(f"_of_{g}") for g in group), "_start")
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return rows.join(starts, same).withColumn("page", F.floor((F.col("_row") - F.col("_start")) / size).cast("int")).select(*df.columns, "page")


def rss_items(df: DataFrame, title: str, link: str, stamp: str) -> DataFrame:
    """One item of a feed for each row, as text."""
    escape = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat(F.lit("<item><title>"), escape(title), F.lit("</title><link>"), escape(link), F.lit("</link><pubDate>"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate></item>")).alias("item"))


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of a table whatever their order: the number of rows and two sums of row hashes."""
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in df.columns]
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    g = F.xxhash64(F.lit(7), *cols).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(h).alias("h"), F.sum(g).alias("g")).first()
    return f"{r['n']}-{r['h'] or 0}-{r['g'] or 0}-{','.join(df.columns)}"


def write_if_changed(df: DataFrame, path: str, keep: int = 3) -> bool:
    """Write a version of a table under path unless its rows are those of the last one; the newest `keep` versions stay.

    Versions are numbered folders, so a reader of one is never disturbed; the digest of the last one is kept beside them."""
    spark = df.sparkSession
    fs, root = _fs(spark, path)
    digest = content_digest(df)
    found = _epochs(fs, root) if fs.exists(root) else []
    last = int(found[-1].getName().split("=e")[1]) if found else 0
    marks = spark.read.text(f"{path}/_digests").collect() if found else []  # a line of each kept version
    known = dict(r["value"].split(" ", 1) for r in marks)
    if known.get(str(last)) == digest:
        return False
    write_epoch(df, path, f"e{last + 1}", keep)
    kept = {k: v for k, v in known.items() if int(k) > last + 1 - keep} | {str(last + 1): digest}
    spark.createDataFrame([(f"{k} {v}",) for k, v in kept.items()], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_digests")
    return True


def numbered(df: DataFrame, by: Sequence[Column], out: str = "row") -> DataFrame:
    """df with the numbers of its rows, from 0, in an order; no task sees more than a range of it.

    The rows are sorted by ranges and written once, so their numbers within a range are fixed; where a range starts follows from the
    counts of those before it, a row each."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the last key splits rows that are equal in all others, however many
    order = [*by, F.col("_tie")]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    path = scratch(spark, "numbered")
    ranged.withColumn("_local", F.monotonically_increasing_id()).write.parquet(path)
    local = spark.read.parquet(path).withColumn("_part", F.shiftright("_local", 33))
    starts, total = [], 0
    for r in local.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    return local.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_start") + F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_local")


def write_in_files(df: DataFrame, path: str, rows: int) -> DataFrame:
    """Write rows as text in files of at most `rows` lines, with an index: (file, rows) of each, in order of name."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").text(path)
    return df.sparkSession.read.text(path).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("rows"))
