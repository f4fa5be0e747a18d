"""Incremental recognition of a stream of documents, on the same marker tables as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from toposcope.operators.project import Project


def recognize_stream(documents: DataFrame, project: Project, module_id: str, predict: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
    """documents: a streaming (id, text).  A repeated micro-batch adds nothing: known ids are skipped."""

    def batch(rows: DataFrame, epoch: int) -> None:
        known = project.documents().select("id")
        project.create_documents(rows.dropDuplicates(["id"]).join(known, "id", "left_anti"))
        project.recognize(module_id, predict)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
