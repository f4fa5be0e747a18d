"""Files read in byte ranges whose meaning depends on what stands before.

Spark's text source splits a file anywhere, by a separator of one's choice.  What a record
needs to know of the records before it (how deep in a document it is, whether a quote is
open, which document it belongs to) is a prefix of the file.  Prefixes are computed in two
steps: within a split, by a window over its records, and over the splits of a file, of which
there are few, by a window over one row for each split.  No file is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.operators.scratch import written

SPLIT = ("file", "split")


def records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, split, n, value: the pieces of files between separators, in order by (split, n); written once."""
    raw = spark.read.option("lineSep", separator).text(path)
    return written(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value"))


def _over(rows: DataFrame, name: str, local: Column, whole: Column, carried: Column, both: Column) -> DataFrame:
    """local: within a split; whole: of a split; carried: over the splits before; both: of `__local` and `__carry`."""
    splits = rows.groupBy(*SPLIT).agg(whole.alias("__whole"))
    carry = splits.select(*SPLIT, carried.alias("__carry"))
    return rows.withColumn("__local", local).join(carry, [*SPLIT]).withColumn(name, both).drop("__local", "__carry")


def _within(last: int):
    """Records of the split up to this one (0) or the one before (-1)."""
    return Window.partitionBy(*SPLIT).orderBy("n").rowsBetween(Window.unboundedPreceding, last)


def _before():
    return Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all earlier records of the file."""
    rows = rows.withColumn("__v", value.cast("long"))
    local = F.sum("__v").over(_within(-1))
    out = _over(rows, name, F.coalesce(local, F.lit(0)), F.sum("__v"), F.coalesce(F.sum("__whole").over(_before()), F.lit(0)), F.col("__local") + F.col("__carry"))
    return out.drop("__v")


def latest(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null, of this or an earlier record of the file."""
    rows = rows.withColumn("__v", value)
    local = F.last("__v", ignorenulls=True).over(_within(0))
    whole = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("n")))
    out = _over(rows, name, local, whole, F.last("__whole", ignorenulls=True).over(_before()), F.coalesce("__local", "__carry"))
    return out.drop("__v")


def together(rows: DataFrame, key: str, glue: str) -> DataFrame:
    """file, key and value: the pieces of each key in order, put together."""
    pieces = F.array_sort(F.collect_list(F.struct("split", "n", "value")))
    return rows.groupBy("file", key).agg(F.array_join(F.transform(pieces, lambda p: p["value"]), glue).alias("value"))


def csv_records(spark: SparkSession, path: str, quote: str | None, skip: int) -> DataFrame:
    """file and value: a line of each record, or several where a quoted field holds line ends.

    The first `skip` lines of a file go, whatever they hold.
    """
    rows = running(records(spark, path), F.lit(1), "line").where(F.col("line") >= skip)
    rows = rows.withColumn("value", F.regexp_replace("value", "\r$", ""))
    if not quote:
        return rows.where("value <> ''").select("file", "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    opened = running(rows.withColumn("quotes", quotes), F.col("quotes"), "before")
    begins = latest(opened, F.when(F.col("before") % 2 == 0, F.struct("split", "n")), "record")
    # most records are one line and need no shuffle by record
    alone = (F.col("before") % 2 == 0) & (F.col("quotes") % 2 == 0)
    many = together(begins.where(~alone), "record", "\n")
    return begins.where(alone & (F.col("value") != "")).select("file", "value").unionByName(many.select("file", "value"))


_ESCAPED = r"\\."
_STRING = r'"(?:[^"\\]|\\.)*"?'
_UP_TO_QUOTE = r'^(?:[^"\\]|\\.)*"?'
_NO_BRACE = r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*'


def json_objects(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """file and value: the JSON objects that stand `depth` objects deep in files, in no order.

    A piece ends with a closing brace, or within a string that has one.
    """
    rows = records(spark, path, "}")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", _ESCAPED, ""), '[^"]', ""))
    rows = running(rows.withColumn("quotes", quotes), F.col("quotes"), "before")
    inside = F.col("before") % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.regexp_replace("value", _UP_TO_QUOTE, "")).otherwise(F.col("value")), _STRING, "")
    closes = (F.col("before") + F.col("quotes")) % 2 == 0
    rows = rows.withColumn("opens", F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))).withColumn("closes", closes)
    rows = running(rows, F.col("opens") - F.col("closes").cast("int"), "depth")
    after = F.col("depth") + F.col("opens") - F.col("closes").cast("int")
    # an object of this depth is complete where its closing brace leads back to it
    rows = running(rows.withColumn("done", F.col("closes") & (after == depth)), F.col("done").cast("int"), "object")
    first = F.col("value")
    for level in range(depth + 1):  # what stands before the object's own brace
        stripped = F.regexp_replace(first, _NO_BRACE, "")
        first = F.when(F.col("depth") <= level, F.substring(stripped, 2, 1 << 30) if level < depth else stripped).otherwise(first)
    held = rows.where((F.col("depth") + F.col("opens") > depth) | (F.col("depth") > depth))
    begun = held.withColumn("value", F.when(F.col("depth") <= depth, first).otherwise(F.col("value")))
    complete = begun.groupBy("file", "object").agg(F.max("done").alias("done")).where("done").drop("done")
    whole = together(begun.join(complete, ["file", "object"]), "object", "}")
    return whole.select("file", F.concat("value", F.lit("}")).alias("value"))
