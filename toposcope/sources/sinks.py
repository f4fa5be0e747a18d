"""Outputs of parsed documents: JSON lines, GeoJSON, results and run checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from toposcope.functions.geo import from_mercator


def document_json(documents: DataFrame, view: DataFrame) -> DataFrame:
    """A JSON object per document (id, text) with its references by start."""
    t = view.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "feature_identifier"))).alias("references"))
    rows = documents.join(t.withColumnRenamed("document_id", "id"), "id", "left")
    return rows.select("id", F.to_json(F.struct("id", "text", F.coalesce("references", F.array()).alias("references"))).alias("value"))


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def wgs84(places: DataFrame, crs: str, x: str = "x", y: str = "y") -> DataFrame:
    """Places with longitude and latitude from coordinates in the crs of their gazetteer."""
    if crs == "EPSG:4326":
        return places.withColumn("longitude", F.col(x)).withColumn("latitude", F.col(y))
    if crs != "EPSG:3857":
        raise ValueError(f"no conversion from {crs}")
    lon, lat = from_mercator(F.col(x), F.col(y))
    return places.withColumn("longitude", lon).withColumn("latitude", lat)


def geojson_features(places: DataFrame) -> DataFrame:
    """(key, value): a GeoJSON feature per row of (key, geometry_json, properties struct)."""
    value = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry_json", F.lit("null")), F.lit(',"properties":'), F.to_json("properties", {"ignoreNullFields": "false"}), F.lit("}"))
    return places.select("key", value.alias("value"))


def geojson_collection(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Collections of a bounded group (such as a document), features ordered by key."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: x["value"]), ",")
    return features.groupBy(*(by or [])).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), parts, F.lit("]}")).alias("value"))


def results_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small summary table; at most `most` rows."""
    got = rows.limit(most).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])


def bar_chart(values: dict[str, float], width: int = 480) -> str:
    """An SVG bar chart of a few named values between 0 and 1."""
    bars = [f'<text x="0" y="{20 * i + 14}" font-size="12">{n}</text><rect x="150" y="{20 * i + 3}" width="{v * (width - 200):.1f}" height="14"/><text x="{155 + v * (width - 200):.1f}" y="{20 * i + 14}" font-size="12">{v:.3f}</text>' for i, (n, v) in enumerate(values.items())]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{20 * len(values) + 6}">{"".join(bars)}</svg>'


def differences(old: dict, new: dict) -> list[str]:
    """Fields in which two run identities differ; none: the run may be resumed."""
    return sorted(k for k in {*old, *new} if old.get(k) != new.get(k))


def checkpoint(completed: DataFrame, path: str, phase: str, identity: dict | None = None) -> None:
    """Add documents (id) that a run has completed in a phase; the run's identity is kept beside them."""
    completed.select("id", F.lit(phase).alias("phase"), F.lit(json.dumps(identity or {}, sort_keys=True)).alias("identity")).write.mode("append").parquet(path)


def resume(spark: SparkSession, path: str, identity: dict | None = None) -> DataFrame:
    """(id, phase) of completed documents; raises if they belong to a run of another identity."""
    try:
        rows = spark.read.schema("id string, phase string, identity string").parquet(path)
    except AnalysisException:  # nothing has been completed yet
        return spark.createDataFrame([], "id string, phase string")
    for r in rows.select("identity").distinct().limit(2).collect():
        if changed := differences(json.loads(r["identity"]), identity or {}):
            raise ValueError(f"the run cannot be resumed: {', '.join(changed)} differ")
    return rows.select("id", "phase").distinct()


def remaining(documents: DataFrame, completed: DataFrame, phase: str) -> DataFrame:
    """Documents that a resumed run has still to do in a phase."""
    return documents.join(completed.where(F.col("phase") == phase).select("id"), "id", "left_anti")


def inspection(documents: DataFrame, references: DataFrame, status: DataFrame) -> DataFrame:
    """Text-free record per document: references, phase status and failures."""
    r = references.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "feature_identifier"))).alias("references"))
    s = status.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "status")))).alias("phases"))
    rows = documents.select(F.col("id").alias("document_id")).join(r, "document_id", "left").join(s, "document_id", "left")
    return rows.select("document_id", F.to_json(F.struct("document_id", F.coalesce("references", F.array()).alias("references"), "phases")).alias("value"))
