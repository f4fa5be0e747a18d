"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MULT = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Only where that setting is missing (local tests) a temporary folder is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("toposcope.local.scratch", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="toposcope-")
            spark.conf.set("toposcope.local.scratch", root)
    return f"{root.rstrip('/')}/toposcope-{uuid.uuid4().hex}"


BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python by BATCH_ROWS at most: with long texts the default takes too much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only, as bytes.lower() does."""
    return F.translate(c, UPPER, UPPER.lower())


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    a = a ^ (a >> np.uint64(31))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a = a ^ (a >> np.uint64(29))
    a = a * MULT
    return a ^ (a >> np.uint64(32))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for repeated words up to a bound."""

    LIMIT = 1 << 16

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, seed=42)
        if len(self) < self.LIMIT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
