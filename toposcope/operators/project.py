"""Project tables: documents, references, referents, markers and tagged views.

All are tables of one snapshot log (operators/snapshots.py).  What a module has done
already is a marker row, committed together with the results, and new work is an
anti-join against the markers.  Every method looks at one version of all tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.functions.text import span_text, unix_newlines
from toposcope.operators.facade import fit
from toposcope.operators.resolve import training_pairs
from toposcope.operators.scratch import written
from toposcope.operators.snapshots import Snapshot, Snapshots

SCHEMAS = {
    "document": "id string, project_id string, text string",
    "recognizer": "id string, name string, config string",
    "resolver": "id string, name string, config string",
    "reference": "id string, document_id string, recognizer_id string, start int, end int, text string",
    "referent": "id string, reference_id string, resolver_id string, gazetteer_name string, feature_identifier string",
    "recognition": "document_id string, recognizer_id string",
    "resolution": "reference_id string, resolver_id string",
    "context": "project_id string, tag string, recognizer_id string, resolver_id string, version long",
}
SPANS = "array<struct<start:int,end:int>>"


def unprocessed(units: DataFrame, markers: DataFrame, unit: str, module: str, module_id: str) -> DataFrame:
    """Units whose id has no marker of the module."""
    done = markers.where(F.col(module) == module_id).select(F.col(unit).alias("id"))
    return units.join(done, "id", "left_anti")


def tag_view(references: DataFrame, referents: DataFrame, documents: DataFrame, context: DataFrame, tag: str) -> DataFrame:
    """References of the tag's recognizer with the referents of its resolver; none without a recognizer."""
    own = context.where(F.col("tag") == tag).select("project_id", F.col("recognizer_id").alias("own_recognizer"), F.col("resolver_id").alias("own_resolver"))
    rows = references.join(documents.select(F.col("id").alias("document_id"), "project_id"), "document_id").join(own, "project_id")
    rows = rows.where(F.col("recognizer_id") == F.col("own_recognizer"))
    links = referents.select(F.col("reference_id").alias("id"), F.col("resolver_id").alias("own_resolver"), "gazetteer_name", "feature_identifier")
    return rows.join(links, ["id", "own_resolver"], "left").select("document_id", "id", "start", "end", "text", "gazetteer_name", "feature_identifier")


def in_order(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of the given ids in their order; unknown ids raise."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
    missing = wanted.join(rows.select("id"), "id", "left_anti").orderBy("pos").limit(5).collect()
    if missing:
        raise KeyError(f"unknown ids: {', '.join(r['id'] for r in missing)}")
    return rows.join(wanted, "id").orderBy("pos").drop("pos")


def with_surfaces(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, spans) of (id, spans), each distinct span with what it covers: texts (id, text) are sent once and end here."""
    surface = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), span_text(F.col("text"), s["start"], s["end"]).alias("text"))
    return found.join(texts, "id").select(F.col("id").alias("document_id"), F.transform(F.array_distinct("spans"), surface).alias("spans"))


def reference_rows(found: DataFrame, module_id: str) -> DataFrame:
    """Rows of the table from spans (document_id, start, end, text); ids follow from what they stand for."""
    return found.select(
        F.substring(F.sha2(F.concat_ws(":", "document_id", F.lit(module_id), "start", "end"), 256), 1, 32).alias("id"),
        "document_id", F.lit(module_id).alias("recognizer_id"), "start", "end", "text",
    )


class Project:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.tables = Snapshots(spark, self.root, SCHEMAS)

    def table(self, name: str) -> DataFrame:
        return self.tables.at().table(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.tables.append({name: rows})

    def register(self, kind: str, module_id: str, name: str, config: str) -> None:
        row = self.spark.createDataFrame([(module_id, name, config)], SCHEMAS[kind])
        self.tables.change(lambda s: {kind: row} if s.table(kind).where(F.col("id") == module_id).isEmpty() else {}, (kind,), add=True)

    def create_documents(self, texts: DataFrame) -> DataFrame:
        """texts: (id, text); line ends become \\n."""
        if not isinstance(texts, DataFrame):
            raise TypeError("documents come as a DataFrame of id and text")
        self.append("document", self._document_rows(texts))
        return self.documents()

    def _document_rows(self, texts: DataFrame) -> DataFrame:
        return texts.select(F.col("id").cast("string").alias("id"), F.lit(self.name).alias("project_id"), unix_newlines(F.col("text")).alias("text"))

    def documents(self, at: Snapshot | None = None) -> DataFrame:
        return (at or self.tables.at()).table("document").where(F.col("project_id") == self.name)

    def _digests(self, at: Snapshot) -> DataFrame:
        return self.documents(at).select(F.col("id").alias("document_id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))

    def tag(self, tag: str, recognizer_id: str | None = None, resolver_id: str | None = None) -> None:
        """Point a tag to modules; the newest row of a tag counts, null keeps what it had."""

        def next_row(s: Snapshot) -> dict[str, DataFrame]:
            old = self.context(s).where(F.col("tag") == tag).collect()
            before = old[0].asDict() if old else {"recognizer_id": None, "resolver_id": None, "version": 0}
            row = (self.name, tag, recognizer_id or before["recognizer_id"], resolver_id or before["resolver_id"], before["version"] + 1)
            return {"context": self.spark.createDataFrame([row], SCHEMAS["context"])}

        self.tables.change(next_row, ("context",), add=True)

    def context(self, at: Snapshot | None = None) -> DataFrame:
        newest = Window.partitionBy("project_id", "tag").orderBy(F.col("version").desc())
        rows = (at or self.tables.at()).table("context").where(F.col("project_id") == self.name)
        return rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")

    def recognize(self, module_id: str, predict: Callable[[DataFrame], DataFrame], name: str = "", config: str = "{}", tag: str = "latest") -> None:
        """predict: (id, text) to (id, spans); null spans mean unavailable and leave no marker."""
        self.register("recognizer", module_id, name, config)
        start = self.tables.at()
        todo = unprocessed(self.documents(start), start.table("recognition"), "document_id", "recognizer_id", module_id)
        found = predict(todo.select("id", "text")).select("id", F.col("spans").cast(SPANS).alias("spans")).where("spans is not null")
        # predictions are written once; what others have committed meanwhile is left out when they are added
        held = written(with_surfaces(found, todo.select("id", "text")))

        def results(s: Snapshot) -> dict[str, DataFrame]:
            done = s.table("recognition").where(F.col("recognizer_id") == module_id).select("document_id")
            fresh = held.join(done, "document_id", "left_anti")
            # a document that has gone or changed since then keeps nothing of its old text; folders never change
            if s.folders.get("document") != start.folders.get("document"):
                same = self._digests(start).join(self._digests(s), ["document_id", "digest"], "left_semi")
                fresh = fresh.join(same, "document_id", "left_semi")
            rows = reference_rows(fresh.select("document_id", F.explode("spans").alias("s")).select("document_id", "s.*"), module_id)
            return {"reference": rows, "recognition": fresh.select("document_id", F.lit(module_id).alias("recognizer_id"))}

        self.tables.change(results, ("document", "recognition"), add=True)
        self.tag(tag, recognizer_id=module_id)

    def resolve(self, module_id: str, predict: Callable[[DataFrame], DataFrame], features: DataFrame, gazetteer: str, name: str = "", config: str = "{}", tag: str = "latest") -> None:
        """predict: references with their document's text to (id, identifier); only known identifiers are kept.

        A reference without a result leaves no marker and is tried again next time.
        """
        self.register("resolver", module_id, name, config)
        start = self.tables.at()
        # what is done goes before references get their document's text, which would be sent along with each
        own = unprocessed(start.table("reference"), start.table("resolution"), "reference_id", "resolver_id", module_id)
        todo = own.join(self.documents(start).select(F.col("id").alias("document_id"), F.col("text").alias("document_text")), "document_id")
        found = written(predict(todo).where("identifier is not null").select("id", "identifier").join(features.select("identifier").distinct(), "identifier", "left_semi"))

        def results(s: Snapshot) -> dict[str, DataFrame]:
            done = s.table("resolution").where(F.col("resolver_id") == module_id).select(F.col("reference_id").alias("id"))
            fresh = found.join(s.table("reference").select("id"), "id", "left_semi").join(done, "id", "left_anti").distinct()
            rows = fresh.select(
                F.substring(F.sha2(F.concat_ws(":", "id", F.lit(module_id)), 256), 1, 32).alias("rid"), F.col("id").alias("reference_id"),
                F.lit(module_id).alias("resolver_id"), F.lit(gazetteer).alias("gazetteer_name"), F.col("identifier").alias("feature_identifier"),
            ).withColumnRenamed("rid", "id")
            return {"referent": rows, "resolution": fresh.select(F.col("id").alias("reference_id"), F.lit(module_id).alias("resolver_id")).distinct()}

        self.tables.change(results, ("reference", "resolution"), add=True)
        self.tag(tag, resolver_id=module_id)

    def view(self, tag: str = "latest") -> DataFrame:
        now = self.tables.at()
        return tag_view(now.table("reference"), now.table("referent"), self.documents(now), self.context(now), tag)

    def create_references(self, spans: DataFrame, label: str) -> str:
        """References (document_id, start, end) made by hand, under a tag of that name; the documents count as done.

        Returns the recognizer's id.  Spans of unknown documents, and such as do not fit their text, raise.
        """
        module_id = "manual-" + label
        bad = spans.join(self.documents().select(F.col("id").alias("document_id"), F.length("text").alias("size")), "document_id", "left").where("size is null or start < 0 or start >= end or end > size")
        if rows := bad.limit(5).collect():
            raise ValueError("spans that fit no document: " + ", ".join(f"{r['document_id']}:{r['start']}-{r['end']}" for r in rows))
        lists = spans.groupBy(F.col("document_id").alias("id")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        self.recognize(module_id, lambda docs: docs.join(lists, "id"), "manual", tag=label)
        return module_id

    def create_referents(self, links: DataFrame, gazetteer: str, label: str) -> str:
        """Features (document_id, start, end, identifier) of references made by hand under the same label.

        Links of no such reference raise.  Returns the resolver's id.
        """
        module_id = "manual-" + label
        own = self.table("reference").where(F.col("recognizer_id") == module_id)
        if rows := links.join(own, ["document_id", "start", "end"], "left_anti").limit(5).collect():
            raise ValueError("links of no reference: " + ", ".join(f"{r['document_id']}:{r['start']}-{r['end']}" for r in rows))
        self.resolve(module_id, lambda refs: refs.where(F.col("recognizer_id") == module_id).join(links, ["document_id", "start", "end"]), links.select("identifier"), gazetteer, "manual", tag=label)
        return module_id

    def annotated(self, tag: str) -> DataFrame:
        """What a recognizer learns from: (id, text, spans) of the documents that the tag's recognizer has done."""
        now = self.tables.at()
        own = self.context(now).where(F.col("tag") == tag).select("recognizer_id")
        done = now.table("recognition").join(own, "recognizer_id").select(F.col("document_id").alias("id"))
        spans = now.table("reference").join(own, "recognizer_id").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
        return self.documents(now).join(done, "id").join(spans, "id", "left").select("id", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    def annotated_mentions(self, tag: str, context: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
        """What a resolver learns from: (id, name, context, gold) of the tag's references that have a feature.

        context: of (text, start, end); the whole text if there is none.
        """
        now = self.tables.at()
        rows = tag_view(now.table("reference"), now.table("referent"), self.documents(now), self.context(now), tag).where("feature_identifier is not null")
        texts = self.documents(now).select(F.col("id").alias("document_id"), F.col("text").alias("document_text"))
        around = context(F.col("document_text"), F.col("start"), F.col("end")) if context else F.col("document_text")
        return rows.join(texts, "document_id").select("id", F.col("text").alias("name"), around.alias("context"), F.col("feature_identifier").alias("gold"))

    def train_recognizer(self, recognizer, tag: str, **options):
        """recognizer.fit over the annotated documents of a tag; TypeError of one that cannot be trained."""
        return fit(recognizer, self.annotated(tag), **options)

    def train_resolver(self, resolver, tag: str, index, descriptions: DataFrame, context=None, **options):
        """resolver.fit over all candidates of the tag's annotated references; TypeError of one that cannot be trained."""
        return fit(resolver, training_pairs(self.annotated_mentions(tag, context), index, descriptions), **options)

    def load_annotations(self, annotations: DataFrame, tag: str = "annotated") -> None:
        """annotations: (document_id, start, end, loc_id): a manual recognizer and resolver in one."""
        self.recognize("manual-" + tag, lambda docs: docs.join(annotations.groupBy(F.col("document_id").alias("id")).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))), "manual", tag=tag)
        links = annotations.where("loc_id <> ''").select("document_id", "start", "end", F.col("loc_id").alias("identifier"))
        self.resolve("manual-" + tag, lambda refs: refs.join(links, ["document_id", "start", "end"]), links.select("identifier"), "manual", "manual", tag=tag)

    def delete(self) -> None:
        """Remove this project's documents, its tags and what hangs on them, in one commit."""
        everything = ("context", "document", "reference", "recognition", "referent", "resolution")
        self.tables.change(lambda s: self._without(s, self.documents(s).select(F.col("id").alias("document_id"))) | {"context": s.table("context").where(F.col("project_id") != self.name)}, everything)

    def _without(self, s: Snapshot, gone: DataFrame) -> dict[str, DataFrame]:
        """Tables without documents (document_id) and all that hangs on them."""
        refs = s.table("reference").join(gone, "document_id", "left_semi").select(F.col("id").alias("reference_id"))
        return {
            "referent": s.table("referent").join(refs, "reference_id", "left_anti"),
            "resolution": s.table("resolution").join(refs, "reference_id", "left_anti"),
            "reference": s.table("reference").join(gone, "document_id", "left_anti"),
            "recognition": s.table("recognition").join(gone, "document_id", "left_anti"),
            "document": s.table("document").join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"),
        }

    def delete_documents(self, ids: DataFrame) -> None:
        """Remove documents (column id) of this project and what hangs on them."""
        asked = written(ids.select(F.col("id").cast("string").alias("id")).distinct())
        self.tables.change(lambda s: self._without(s, self.documents(s).join(asked, "id", "left_semi").select(F.col("id").alias("document_id"))), ("document", "reference", "recognition", "referent", "resolution"))

    def update_documents(self, texts: DataFrame) -> None:
        """New texts (id, text) of known documents; what was found in the old ones goes, unless the text is the same."""
        asked = written(self._document_rows(texts).dropDuplicates(["id"]))

        def changed(s: Snapshot) -> dict[str, DataFrame]:
            old = self.documents(s).select("id", F.col("text").alias("was"))
            new = asked.join(old, "id").where(~F.col("text").eqNullSafe(F.col("was"))).select("id", "project_id", "text")
            out = self._without(s, new.select(F.col("id").alias("document_id")))
            return out | {"document": out["document"].unionByName(new)}

        self.tables.change(changed, ("document", "reference", "recognition", "referent", "resolution"))

    def update_references(self, spans: DataFrame) -> None:
        """Move references (id, start, end): their text is read anew, and what they were resolved to goes."""
        asked = written(spans.select(F.col("id").cast("string").alias("id"), F.col("start").cast("int").alias("new_start"), F.col("end").cast("int").alias("new_end")).dropDuplicates(["id"]))

        def moved(s: Snapshot) -> dict[str, DataFrame]:
            texts = self.documents(s).select(F.col("id").alias("document_id"), F.col("text").alias("document_text"))
            rows = s.table("reference").join(asked, "id").join(texts, "document_id")
            new = rows.select("id", "document_id", "recognizer_id", F.col("new_start").alias("start"), F.col("new_end").alias("end"), span_text(F.col("document_text"), F.col("new_start"), F.col("new_end")).alias("text"))
            own = new.select("id")
            return {
                "reference": s.table("reference").join(own, "id", "left_anti").unionByName(new),
                "referent": s.table("referent").join(own.withColumnRenamed("id", "reference_id"), "reference_id", "left_anti"),
                "resolution": s.table("resolution").join(own.withColumnRenamed("id", "reference_id"), "reference_id", "left_anti"),
            }

        self.tables.change(moved, ("document", "reference", "referent", "resolution"))
