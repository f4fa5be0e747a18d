"""A table in random order, dealt to shards: external shuffle in two passes, in DataFrame operations only.

Pass one scatters rows to buckets by a seeded hash of where each row is stored, not of what
it holds, so copies of one row, or of one key, spread like any other rows.  There are as
many buckets as are needed for `bucket_bytes` each, and each is a partition of its own.
Pass two puts the rows of a bucket into one array, in the order of their hash, shuffles
that array (Spark's `shuffle` is a Fisher-Yates shuffle from a seed) and writes it.  Both
passes depend on stored addresses and seeds only: a task that runs again gives the same rows.

The order of all rows is that of the buckets, one behind the other.  Shards are
consecutive pieces of it whose counts differ by one at most, so a bucket goes to one shard
or to the few that meet in it.

Defined results: each row is dealt once, with nulls, empty texts and repeated rows like any
others; texts that are equal are dealt one by one and need not meet; a row larger than a
bucket makes its bucket larger; an empty table gives empty shards; columns named shard or
slot, in any case, are replaced, others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.llm._shared import scratch, stash, table

SHARDS = 24
SEED = 20240229
#: a task holds a few copies of one bucket
BUCKET_BYTES = 32 << 20
RESULTS = ("shard", "slot")


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct", "variant")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return total


def shard_of(position: Column, n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position in the order of n rows; the first n mod shards have one row more."""
    least, more = divmod(n, shards)
    edge = more * (least + 1)
    high, low = F.lit(least + 1), F.lit(max(1, least))
    shard = F.when(position < edge, F.floor(position / high)).otherwise(more + F.floor((position - edge) / low))
    slot = F.when(position < edge, position % high).otherwise((position - edge) % low)
    return shard.cast("int"), slot.cast("long")


def external_shuffle(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, stored: bool = False) -> DataFrame:
    """Write df to path in random order, in folders by shard; returns it with `shard` and `slot`.

    stored: df is a scan of Parquet files, whose rows have addresses; else it is written first.
    """
    spark = df.sparkSession
    if not stored:
        df = stash(df, scratch(spark))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    at = df.metadataColumn("_metadata")
    address = [F.xxhash64(F.lit(seed), at["file_name"], at["row_index"]).alias("hash"), at["file_path"].alias("file"), at["row_index"].alias("row")]
    bucket = F.pmod(F.col("hash"), F.lit(buckets)).cast("int").alias("bucket")

    # a number for each bucket of memory size: a million of them for 32 TB
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.select(*address).select(bucket).groupBy("bucket").count()
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in RESULTS]
    rows = df.select(*address, F.struct(*kept).alias("record")).select(bucket, F.struct("hash", "file", "row", "record").alias("r"))
    arrays = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    mixed = arrays.select("bucket", F.posexplode(F.shuffle("rs", seed)).alias("pos", "r"))
    position = F.col("start") + F.col("pos")
    shard, slot = shard_of(position, n, shards)
    placed = mixed.join(starts, "bucket").select("r.record.*", shard.alias("shard"), slot.alias("slot"))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shuffled order over 24 shards whose counts are at most one apart (law `rows`)."""
    out = external_shuffle(table(spark, sf_dir, "documents"), scratch(spark), stored=True)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
