"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of all benchmark items (ten consecutive words; a shorter item is one window)
are hashed.  Tasks roll the same hashes over every document, look them up in the set,
verify each hit on the words themselves, and return the words and characters that hits
cover.  A window takes 16 bytes of the set and its place in its item's word list, so a
part of `max_windows` windows takes about 100 MB in a task; the set is broadcast only in
parts of at most that: a larger benchmark takes more passes, whose hits are merged per
document.  The windows of one item stay in one part.

Defined results: null and empty texts have no words and no hits; repeated rows are
treated alike; items of the same id count once; an item whose id is null marks words but
is not listed; an empty benchmark hits nothing.  Further columns of the documents pass
through `scan` unchanged unless they have the name of a result column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import WordHashes, encode, mix, scratch, small_batches, stash, table

#: words in a text whose letters A to Z are still in either case
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_BASE = np.uint64(0xD6E8FEB86659FD93)

RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return encode(text).lower().translate(_BREAKS).split()


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : k + n]
    return mix(out)


class WindowSet:
    """Sorted hashes of windows for each width, with the place of each in its item's words."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        hashes, found, known = WordHashes(), {}, {}
        self.items, self.words, self.seen = [], [], {}
        for item, text in items:
            words = words_of(text)
            size = min(width, len(words))
            if not size:
                continue
            words = [known.setdefault(w, w) for w in words]
            keys, at = np.unique(_rolled(hashes.of(words), size), return_inverse=True)
            first = np.full(len(keys), -1)
            places = []
            for i, k in enumerate(at.tolist()):  # each window of the item once, those of equal hash and other words too
                if first[k] < 0:
                    first[k] = i
                    places.append(i)
                elif words[first[k] : first[k] + size] != words[i : i + size]:
                    places.append(i)
            got = found.setdefault(size, ([], [], []))
            got[0].append(keys[at[places]])
            got[1].append(np.full(len(places), len(self.items), dtype=np.int32))
            got[2].append(np.array(places, dtype=np.int32))
            self.items.append(item)
            self.words.append(words)
        self.keys, self.of, self.place, self.maybe = {}, {}, {}, {}
        for size, (keys, of, place) in found.items():
            keys, of, place = np.concatenate(keys), np.concatenate(of), np.concatenate(place)
            order = np.argsort(keys, kind="stable")
            self.keys[size], self.of[size], self.place[size] = keys[order], of[order], place[order]
            bits = np.zeros(1 << 20, dtype=bool)
            bits[keys >> np.uint64(44)] = True
            self.maybe[size] = bits

    def _group(self, size: int, at: int) -> list[tuple[list[bytes], set]]:
        """Windows that share the hash at a place of the keys: their words, with their items."""
        got = self.seen.get((size, at))
        if got is None:
            end = int(np.searchsorted(self.keys[size], self.keys[size][at], side="right"))
            by_words: dict[tuple, set] = {}
            for i in range(at, end):
                of, place = int(self.of[size][i]), int(self.place[size][i])
                by_words.setdefault(tuple(self.words[of][place : place + size]), set()).add(self.items[of])
            got = self.seen[size, at] = [(list(w), x) for w, x in by_words.items()]
        return got

    def hits(self, words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        edge, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        for size, keys in self.keys.items():
            rolled = _rolled(h, size)
            at = np.flatnonzero(self.maybe[size][rolled >> np.uint64(44)])
            if not len(at):
                continue
            where = np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)
            same = keys[where] == rolled[at]
            for i, g in zip(at[same].tolist(), where[same].tolist(), strict=True):
                for own, got in self._group(size, g):
                    if own == words[i : i + size]:
                        edge[i] += 1
                        edge[i + size] -= 1
                        items |= got
        return np.cumsum(edge[:-1]) > 0, items


def char_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Spans in code points over runs of hit words."""
    out = []
    for at, m in enumerate(WORD.finditer(text)):
        if hit[at]:
            if at and hit[at - 1]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
    return out


def _scanner(shared, text_at: int, keep: list[int], cleaned: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, hashes = shared.value, WordHashes()
        kinds = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n_words, n_hit, items, spans, rest = [], [], [], [], []
                for text in batch.column(text_at):
                    text = text.as_py()
                    words = words_of(text)
                    hit, got = windows.hits(words, hashes.of(words))
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(x for x in got if x is not None))
                    spans.append(char_spans(text, hit) if n_hit[-1] else [])
                    rest.append(cut(text, spans[-1]) if cleaned and n_hit[-1] else None)
                cols = [batch.column(i) for i in keep]
                names = [*(batch.schema.names[i] for i in keep), "n_words", "n_hit", "items", "hits"]
                cols += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, kinds[0]), pa.array(spans, kinds[1])]
                if cleaned:
                    cols.append(pa.array(rest, pa.string()))
                    names.append("cleaned")
                yield pa.RecordBatch.from_arrays(cols, names)

    return scan


def _merged(df: DataFrame) -> DataFrame:
    """Rows of several passes over the same documents, put together by __row."""
    spans = F.array_sort(F.flatten(F.collect_list("hits")))
    return df.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        spans.alias("hits"),
    )


def _union(spans: list) -> list:
    out: list = []
    for s in spans:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def scan(documents: DataFrame, benchmark: DataFrame, width: int = 10, max_windows: int = 2_000_000, keep_text: bool = False, cleaned: bool = False) -> DataFrame:
    """documents (without text unless keep_text) plus n_words, n_hit, items and hits.

    cleaned: also the column of that name, the text without the hits; null without a hit.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sizes = benchmark.select(F.sum(F.length("text")).alias("n")).first()
    # a window begins at a word of at least one character and a break
    parts = max(1, -(-int(sizes["n"] or 0) // (2 * max_windows)))
    added = ("n_words", "n_hit", "items", "hits", *(("cleaned",) if cleaned else ()))
    docs = documents.drop(*added)
    fields = docs.schema.fields
    text_at = docs.columns.index("text")
    keep = [i for i, f in enumerate(fields) if keep_text or i != text_at]
    schema = T.StructType([fields[i] for i in keep] + T.StructType.fromDDL(RESULT).fields)
    if cleaned:
        schema.add("cleaned", "string")

    def one(part: int, rows: DataFrame, kept: list[int], kind: T.StructType, cleaned: bool) -> DataFrame:
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
        if parts > 1:
            items = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(WindowSet([(r["item"], r["text"]) for r in items.toLocalIterator()], width))
        return rows.mapInArrow(_scanner(shared, rows.columns.index("text"), kept, cleaned), kind)

    if parts == 1:
        return one(0, docs, keep, schema, cleaned)
    # the numbers of the rows are fixed once they are written
    rows = stash(docs.withColumn("__row", F.monotonically_increasing_id()), f"{scratch(spark)}/rows")
    slim = rows.select("__row", "text")
    kind = T.StructType([slim.schema["__row"], *T.StructType.fromDDL(RESULT).fields])
    passes = [one(p, slim, [0], kind, False) for p in range(parts)]
    both = passes[0]
    for x in passes[1:]:
        both = both.unionByName(x)
    joined = rows.join(_merged(both), "__row")
    count = _recount(spark)
    out = joined.withColumn("__c", count("text", "hits")).withColumn("n_hit", F.col("__c.n_hit")).withColumn("hits", F.col("__c.hits")).withColumn("cleaned", F.col("__c.cleaned"))
    return out.select(*[f.name for f in schema.fields])


def _recount(spark: SparkSession):
    @F.pandas_udf("n_hit long, hits array<struct<start:int,end:int>>, cleaned string")
    def recount(text: pd.Series, hits: pd.Series) -> pd.DataFrame:
        n, merged, rest = [], [], []
        for t, s in zip(text, hits, strict=True):
            spans = _union(sorted(({"start": x["start"], "end": x["end"]} for x in s), key=lambda x: (x["start"], x["end"])))
            n.append(sum(len(WORD.findall(t[x["start"] : x["end"]])) for x in spans))
            merged.append(spans)
            rest.append(cut(t, spans) if spans else None)
        return pd.DataFrame({"n_hit": n, "hits": merged, "cleaned": rest})

    return recount


def cut(text: str, spans: list) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def remove_spans(documents: DataFrame, benchmark: DataFrame, width: int = 10, drop_share: float = 1.0) -> DataFrame:
    """documents without benchmark passages, with n_chars counted anew where a text changed.

    Hit spans are removed from the text.  A document of which hits cover at least
    drop_share of the words is removed whole (1.0: nothing else would be left of it).
    Clean documents pass unchanged, those without words too.
    """
    names = documents.columns
    found = scan(documents, benchmark, width, keep_text=True, cleaned=True)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < drop_share * F.col("n_words")))
    out = kept.withColumn("__new", F.when(F.col("n_hit") > 0, F.col("cleaned")).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("__new").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__new")).select(*names)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS words FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS words, least(10, len({_WORDS_SQL})) AS size FROM benchmark),
    bw AS (SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM b WHERE size > 0)),
    dw AS (SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
    hit AS (SELECT rid, size, i, item FROM dw JOIN bw USING (size, win)),
    n AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM hit) GROUP BY 1),
    items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (rid) LEFT JOIN items USING (rid)"""
