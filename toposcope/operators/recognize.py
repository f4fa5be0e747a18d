"""Recognizers: DataFrames of (id, text) to (id, spans); null spans mean unavailable."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN_LIST = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def manual(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """known: (text, spans); the first row of a text wins by `pos` if given; other texts are unavailable."""
    order = F.col("pos") if "pos" in known.columns else F.monotonically_increasing_id()
    first = known.withColumn("__r", F.row_number().over(Window.partitionBy("text").orderBy(order))).where("__r = 1").select("text", "spans")
    return lambda docs: docs.join(first, "text", "left").select("id", "spans")


def dictionary(words: DataFrame, most_words: int = 3) -> Callable[[DataFrame], DataFrame]:
    """Spans of word runs that occur in a dictionary (column word), compared in lower case.

    Runs are made per document and joined to the dictionary, which may be large.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("word", T.StringType())])))
    def runs(text: pd.Series) -> pd.Series:
        import re

        out = []
        for t in text:
            at = [m.span() for m in re.finditer(r"\w+", t or "")]
            own = [(at[i][0], at[j][1]) for i in range(len(at)) for j in range(i, min(i + most_words, len(at)))]
            out.append([{"start": s, "end": e, "word": " ".join(t[s:e].lower().split())} for s, e in own])
        return pd.Series(out, dtype=object)

    def predict(docs: DataFrame) -> DataFrame:
        own = docs.select("id", F.explode(runs("text")).alias("r")).select("id", "r.*")
        known = words.select(F.lower(F.trim("word")).alias("word")).distinct()
        hits = own.join(known, "word", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        return docs.select("id").join(hits, "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))

    return predict


def pieces(text: str, window: int, overlap: int) -> list[tuple[int, str]]:
    """Windows of a long text with where they begin; the last one ends with the text."""
    step = window - overlap
    starts = [0, *range(step, max(1, len(text) - overlap), step)] if len(text) > window else [0]
    return [(at, text[at : at + window]) for at in starts]


def model(load: Callable[[], Callable[[list[str]], list]], batch: int = 32, most_chars: int | None = None, window: int | None = None, overlap: int = 200) -> Callable[[DataFrame], DataFrame]:
    """Any model: load() runs once per task and returns texts -> lists of (start, end) or None.

    most_chars: longer texts are not given to the model and are unavailable.  window: longer
    texts are given in windows that overlap, and their spans put together; a text is
    unavailable if one of its windows is.  Null texts are unavailable.
    """
    if window is not None and not 0 <= overlap < window:
        raise ValueError("windows must be longer than their overlap")

    def run(batches):
        own = load()
        for pdf in batches:
            asked = []
            for i, text in enumerate(pdf["text"]):
                if text is not None and (most_chars is None or len(text) <= most_chars):
                    asked += [(i, at, part) for at, part in (pieces(text, window, overlap) if window else [(0, text)])]
            found: list = [None] * len(pdf)
            failed = set()
            for k in range(0, len(asked), batch):
                some = asked[k : k + batch]
                for (i, at, _), spans in zip(some, own([part for _, _, part in some]), strict=True):
                    if spans is None:
                        failed.add(i)
                    else:
                        found[i] = (found[i] or set()) | {(a + at, b + at) for a, b in spans}
            rows = [None if s is None or i in failed else [{"start": a, "end": b} for a, b in sorted(s)] for i, s in enumerate(found)]
            yield pd.DataFrame({"id": pdf["id"], "spans": pd.Series(rows, index=pdf.index, dtype=object)})

    def predict(docs: DataFrame) -> DataFrame:
        return docs.select("id", "text").mapInPandas(run, T.StructType([docs.schema["id"], T.StructField("spans", SPAN_LIST)]))

    return predict


def checked(scored: Column, text: Column, threshold: float) -> Column:
    """Model output (start, end, score, surface) to spans: above the threshold, in range, on the right surface."""
    good = F.filter(scored, lambda s: (s["score"] > threshold) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["surface"]))
    return F.array_sort(F.array_distinct(F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))


def adjacent_overlaps(spans: DataFrame, key: str = "document_id") -> DataFrame:
    """Spans that begin before the one before them ends."""
    w = Window.partitionBy(key).orderBy("start", "end")
    return spans.withColumn("before", F.lag("end").over(w)).where(F.col("start") < F.col("before"))


def distinct_labels(groups: Column) -> Column:
    """Spans of several label lists, each once, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(groups)))
