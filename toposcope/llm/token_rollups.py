"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch is a set of signed rows: +1 inserts a text, -1 deletes one, and a revision is the
deletion of the old row with the insertion of the new one.  Tasks count tokens and emit
sums of each Arrow batch, not rows of each text, so a hot source is summed before any
shuffle.  Each attempt at a batch writes its additive deltas to a new folder, then a marker
that names batch and folder commits it.  A batch counts once however often it is tried:
once committed, a retry does nothing, and of two writers at the same time the lesser
folder counts.  Totals are sums over committed batches; `compact` folds them into one
batch that lists what it holds.  A name is used once, for a batch or a compaction.
Commits may run beside each other and beside a compaction, compactions not.

Tokenizers are named by version: `words-1` counts runs of non-space characters, others
are byte-level BPE rank files, whose path is a parameter.  Rank files are of bounded size
(tens of thousands of entries) and are broadcast.

Defined results: a null text has no tokens but counts as a document; null source or
language are groups of their own; rows of an empty batch commit an empty delta; groups
whose documents and tokens are all 0 are left out of the totals; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from toposcope.llm._shared import encode, scratch, small_batches, table

WORDS = "words-1"
BPE_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: fixed value: the pattern that splits text before byte-pair merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter:
    """Number of tokens of a text under one tokenizer."""

    def __init__(self, ranks: dict[bytes, int] | None):
        self.encoding = None
        if ranks is not None:
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.encoding is None:
            return len(encode(text).split())
        return len(self.encoding.encode_ordinary(text))


def _delta_task(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: Counter(ranks) for name, ranks in shared.value.items()}
        for batch in batches:
            sums: dict = {}
            for source, lang, text, sign in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, sign = text.as_py(), sign.as_py()
                for name, counter in counters.items():
                    own = sums.setdefault((source.as_py(), lang.as_py(), name), [0, 0])
                    own[0] += sign
                    own[1] += sign * counter(text)
            cols = [[k[i] for k in sums] for i in range(3)] + [[v[i] for v in sums.values()] for i in range(2)]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source", "lang", "tokenizer", "n_docs", "n_tokens"])

    return count


def deltas(rows: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """Additive deltas of signed rows (source, lang, text, sign)."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast({name: read_ranks(path) if path else None for name, path in tokenizers.items()})
    parts = rows.select("source", "lang", "text", F.col("sign").cast("long").alias("sign")).mapInArrow(_delta_task(shared), DELTA)
    return parts.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace old texts by new ones; both have source, lang and text."""
    cols = ("source", "lang", "text")
    return old.select(*cols, F.lit(-1).alias("sign")).unionByName(new.select(*cols, F.lit(1).alias("sign")))


class Rollup:
    """Committed totals in a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _markers(self) -> list[Row]:
        """One marker of each batch."""
        try:
            rows = self.spark.read.schema("batch string, folder string, holds array<string>").parquet(f"{self.path}/commits/*")
        except AnalysisException:  # nothing has been committed
            return []
        return rows.groupBy("batch").agg(F.min(F.struct("folder", "holds")).alias("m")).select("batch", "m.folder", "m.holds").collect()

    def committed(self) -> set[str]:
        """Names of batches, those folded into another included."""
        return {b for r in self._markers() for b in (r["batch"], *(r["holds"] or ()))}

    def _live(self) -> dict[str, str]:
        """Batches that no other holds, with their folders."""
        rows = self._markers()
        held = [b for r in rows for b in r["holds"] or ()]
        if len(held) != len(set(held)):
            raise RuntimeError("two compactions hold the same batch")
        return {r["batch"]: r["folder"] for r in rows if r["batch"] not in held}

    def _write(self, batch: str, rows: DataFrame, holds: list[str]) -> None:
        folder = f"{batch}-{uuid.uuid4().hex}"
        rows.write.mode("error").parquet(f"{self.path}/deltas/{folder}")
        held = F.array(*map(F.lit, holds)) if holds else F.array().cast("array<string>")
        mark = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), held.alias("holds"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/commits/{batch}")

    def commit(self, batch: str, rows: DataFrame, tokenizers: dict[str, str | None]) -> bool:
        """Apply signed rows once; False if the batch had been committed before."""
        if batch in self.committed():
            return False
        self._write(batch, deltas(rows, tokenizers), [])
        return True

    def _sums(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], DELTA)
        parts = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/deltas/{folder}" for folder in live.values()))
        sums = parts.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sums(self._live())

    def compact(self, batch: str) -> None:
        """Fold all live batches into a new one, which then counts instead of them."""
        if batch in self.committed():
            raise ValueError(f"{batch!r} has been used")
        live = self._live()
        self._write(batch, self._sums(live), sorted(live))


def op5_token_rollups(spark: SparkSession, sf_dir: str, bpe_file: str = BPE_FILE) -> DataFrame:
    """Documents are inserted without their texts, then revised; a retry and a compaction change nothing."""
    rollup = Rollup(spark, scratch(spark))
    tokenizers = {WORDS: None, "byte_bpe_50k-1": bpe_file}
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    bare = docs.withColumn("text", F.lit(None).cast("string"))
    rollup.commit("announced", revision(bare.limit(0), bare), tokenizers)
    for _ in range(2):
        rollup.commit("texts", revision(bare, docs), tokenizers)
    rollup.compact("base")
    return rollup.totals()
