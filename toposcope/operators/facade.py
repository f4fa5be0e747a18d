"""Texts to resolved documents in one call, and training calls sent to the module that can take them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.functions.text import span_text, unix_newlines

SPANS = "array<struct<start:int,end:int>>"


def as_documents(spark: SparkSession, texts: str | list[str] | DataFrame) -> DataFrame:
    """(id, text): of one text, of a list (numbered from 0), or of a DataFrame that has both."""
    if isinstance(texts, str):
        texts = [texts]
    if not isinstance(texts, DataFrame):
        if not all(isinstance(t, str) for t in texts):
            raise TypeError("texts are strings")
        texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return texts.select(F.col("id").cast("string").alias("id"), unix_newlines(F.col("text")).alias("text"))


def parse(spark: SparkSession, texts: str | list[str] | DataFrame, recognize: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], DataFrame], features: DataFrame, data: tuple[str, ...] = ()) -> DataFrame:
    """Documents (id, text, toponyms): what was found in each text, in order, with its feature.

    recognize: (id, text) to (id, spans); resolve: references (id, document_id, start, end,
    text, document_text) to (id, identifier).  A toponym has start, end, text, identifier
    (null where none was found or known) and the wanted columns of the features.  Texts
    for which the recognizer is unavailable have null toponyms, others without any an
    empty list.
    """
    docs = as_documents(spark, texts)
    spans = recognize(docs).select("id", F.col("spans").cast(SPANS).alias("spans"))
    found = docs.join(spans, "id", "left")
    each = found.select(F.col("id").alias("document_id"), F.col("text").alias("document_text"), F.explode(F.array_distinct("spans")).alias("s"))
    refs = each.select(
        F.concat_ws(":", "document_id", "s.start", "s.end").alias("id"), "document_id", "s.start", "s.end",
        span_text(F.col("document_text"), F.col("s.start"), F.col("s.end")).alias("text"), "document_text",
    )
    known = features.select("identifier", *data).dropDuplicates(["identifier"])
    links = resolve(refs).select("id", "identifier").join(known, "identifier")
    whole = refs.drop("document_text").join(links, "id", "left")
    item = F.struct("start", "end", "text", "identifier", *data)
    lists = whole.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("__t"))
    empty = F.when(F.col("spans").isNotNull(), F.array().cast(lists.schema["__t"].dataType))
    return found.join(lists, "id", "left").select("id", "text", F.coalesce("__t", empty).alias("toponyms"))


def fit(module, *data, **options):
    """module.fit(...) of a recognizer or resolver that can be trained; TypeError of one that cannot."""
    train = getattr(module, "fit", None)
    if not callable(train):
        raise TypeError(f"{getattr(module, '__name__', type(module).__name__)} cannot be trained")
    return train(*data, **options)
