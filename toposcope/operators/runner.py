"""A benchmark run in phases and chunks that can be stopped anywhere and taken up again.

Documents are dealt to chunks by a hash of their id.  A chunk of a phase is computed, and
its results, its failures and its marker are committed together (operators/snapshots.py), so
a chunk counts wholly or not at all; one that has a marker is not computed again.  A
later phase reads what the one before has committed for the same documents.  Scores are
given only if all chunks of all phases are there.

A run is known by its identity (settings, versions, a digest of the corpus): another one
is refused.  Each chunk's wall time is kept, with a mark on the first one of each process and
phase, in which models are loaded; throughput leaves those out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.operators.scratch import written
from toposcope.operators.snapshots import Snapshot, Snapshots
from toposcope.sources.sinks import differences

SCHEMAS = {
    "identity": "identity string, chunks int",
    "chunk": "phase string, chunk int, documents long, seconds double, warming boolean",
    "result": "phase string, chunk int, id string, value string",
    "failure": "phase string, chunk int, id string, error string",
}


class IncompleteError(RuntimeError):
    pass


class Run:
    """phases: names with functions of documents (id, text, and `before`, the value of the phase before, if any).

    A function returns (id, value) or (id, value, error): a value is JSON or other text, a
    row with an error is a failure of that document alone.  A document without a row has failed too.
    """

    def __init__(self, spark: SparkSession, root: str, phases: dict[str, Callable[[DataFrame], DataFrame]], identity: dict, chunks: int = 16):
        self.spark, self.phases, self.chunks = spark, phases, chunks
        self.tables = Snapshots(spark, root, SCHEMAS)
        own = json.dumps(identity, sort_keys=True)

        def agreed(s: Snapshot) -> dict[str, DataFrame]:
            known = s.table("identity").collect()
            if not known:
                return {"identity": spark.createDataFrame([(own, chunks)], SCHEMAS["identity"])}
            old = json.loads(known[0]["identity"]) | {"chunks": known[0]["chunks"]}
            if changed := differences(old, json.loads(own) | {"chunks": chunks}):
                raise ValueError(f"the run cannot be resumed: {', '.join(changed)} differ")
            return {}

        self.tables.change(agreed, ("identity",))

    def done(self, phase: str) -> set[int]:
        return {r["chunk"] for r in self.tables.at().table("chunk").where(F.col("phase") == phase).select("chunk").distinct().collect()}

    def go(self, documents: DataFrame) -> None:
        """Compute what is missing, phase by phase."""
        docs = documents.select(F.col("id").cast("string").alias("id"), "text")
        part = F.pmod(F.xxhash64("id"), F.lit(self.chunks)).cast("int")
        before = None
        for phase, function in self.phases.items():
            warming, done = True, self.done(phase)
            for chunk in (c for c in range(self.chunks) if c not in done):
                own = docs.where(part == chunk)
                if before is not None:  # documents that failed in the phase before have nothing to go on with
                    held = self.tables.at().table("result").where((F.col("phase") == before) & (F.col("chunk") == chunk))
                    own = own.join(held.select("id", F.col("value").alias("before")), "id")
                self._chunk(phase, chunk, own, function, warming)
                warming = False
            before = phase

    def _chunk(self, phase: str, chunk: int, own: DataFrame, function: Callable[[DataFrame], DataFrame], warming: bool) -> None:
        began = time.monotonic()
        out = function(own)
        error = F.col("error").cast("string") if "error" in out.columns else F.lit(None).cast("string")
        got = written(own.select("id").distinct().join(out.select("id", F.col("value").cast("string").alias("value"), error.alias("error"), F.lit(True).alias("there")), "id", "left"))
        seconds, n = time.monotonic() - began, got.select("id").distinct().count()
        mark = self.spark.createDataFrame([(phase, chunk, n, seconds, warming)], SCHEMAS["chunk"])
        at = (F.lit(phase).alias("phase"), F.lit(chunk).alias("chunk"), "id")
        failed = got.where("error is not null or there is null").select(*at, F.coalesce("error", F.lit("no result")).alias("error"))
        found = got.where("error is null and there").select(*at, "value")

        def once(s: Snapshot) -> dict[str, DataFrame]:  # another process may have done the same chunk
            if not s.table("chunk").where((F.col("phase") == phase) & (F.col("chunk") == chunk)).isEmpty():
                return {}
            return {"result": found, "failure": failed, "chunk": mark}

        self.tables.change(once, ("chunk",), add=True)

    def missing(self) -> dict[str, list[int]]:
        """Chunks that each phase has still to do; phases that are complete are left out."""
        left = {phase: sorted({*range(self.chunks)} - self.done(phase)) for phase in self.phases}
        return {phase: chunks for phase, chunks in left.items() if chunks}

    def results(self, phase: str) -> DataFrame:
        """(id, value) of a complete run; raises if any chunk is missing."""
        if left := self.missing():
            raise IncompleteError("chunks are missing: " + "; ".join(f"{p}: {', '.join(map(str, c))}" for p, c in left.items()))
        return self.tables.at().table("result").where(F.col("phase") == phase).select("id", "value")

    def failures(self) -> DataFrame:
        return self.tables.at().table("failure").select("phase", "id", "error")

    def throughput(self) -> DataFrame:
        """phase, documents, seconds and documents per second, without chunks in which models were loaded."""
        timed = self.tables.at().table("chunk").where(~F.col("warming")).groupBy("phase").agg(F.sum("documents").alias("documents"), F.sum("seconds").alias("seconds"))
        return timed.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("documents") / F.col("seconds")))
