"""Data operations of the annotator: overlaps, progress, propagation, ordering, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(toponyms: DataFrame) -> DataFrame:
    """Pairs of toponyms of a document whose spans overlap (id < other_id)."""
    a = toponyms.select("document_id", "id", "start", "end")
    b = toponyms.select("document_id", F.col("id").alias("other_id"), F.col("start").alias("s"), F.col("end").alias("e"))
    return a.join(b, "document_id").where((F.col("start") < F.col("e")) & (F.col("end") > F.col("s")) & (F.col("id") < F.col("other_id"))).select("document_id", "id", "other_id")


def new_spans(spans: DataFrame, known: DataFrame) -> DataFrame:
    keys = ["document_id", "start", "end"]
    return spans.dropDuplicates(keys).join(known, keys, "left_anti").orderBy("document_id", "start")


def progress(documents: DataFrame, toponyms: DataFrame) -> DataFrame:
    """Toponyms and annotated ones per document; a null loc_id counts as annotated, '' does not."""
    rows = documents.select(F.col("id").alias("document_id")).join(toponyms.select("document_id", F.col("id").alias("t"), "loc_id"), "document_id", "left")
    annotated = F.col("t").isNotNull() & ~F.col("loc_id").eqNullSafe("")
    out = rows.groupBy("document_id").agg(F.count("t").alias("total"), F.count_if(annotated).alias("annotated"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("annotated") / F.col("total")))


def propagate(toponyms: DataFrame, annotations: DataFrame) -> DataFrame:
    """One sense per discourse: the annotation's loc_id for unannotated mentions of the same text in the document."""
    chosen = annotations.groupBy("document_id", "text").agg(F.max("loc_id").alias("chosen"))
    rows = toponyms.join(chosen, ["document_id", "text"], "left")
    return rows.withColumn("loc_id", F.when((F.col("loc_id") == "") & F.col("chosen").isNotNull(), F.col("chosen")).otherwise(F.col("loc_id"))).drop("chosen")


def next_index(documents: DataFrame) -> DataFrame:
    return documents.groupBy("session_id").agg((F.coalesce(F.max("doc_index"), F.lit(-1)) + 1).alias("next"))


def reindex(documents: DataFrame) -> DataFrame:
    """Dense doc_index per session after deletions."""
    w = Window.partitionBy("session_id").orderBy("doc_index", "id")
    return documents.withColumn("doc_index", F.row_number().over(w) - 1)


def candidate_list(found: DataFrame, annotated: DataFrame) -> DataFrame:
    """Search results of mentions, with the annotated feature added where the search lacks it."""
    missing = annotated.join(found, ["mention_id", "identifier"], "left_anti").withColumn("position", F.lit(1 << 30))
    return found.select("mention_id", "identifier", "position").unionByName(missing.select("mention_id", "identifier", "position"))


def export_session(sessions: DataFrame, documents: DataFrame, toponyms: DataFrame) -> DataFrame:
    """One JSON object per session: documents in order, toponyms by start."""
    t = toponyms.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "loc_id"))).alias("toponyms"))
    d = documents.join(t.withColumnRenamed("document_id", "id"), "id", "left")
    d = d.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("doc_index", "filename", "text", "toponyms"))).alias("documents"))
    rows = sessions.join(d.withColumnRenamed("session_id", "id"), "id", "left")
    return rows.select("id", F.to_json(F.struct("gazetteer", "documents")).alias("json"))
