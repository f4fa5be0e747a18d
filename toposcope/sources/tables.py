"""Scans of gazetteer sources: delimited text, GeoJSON, shapefile and GeoPackage, whole texts."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from toposcope.functions import geo, projections
from toposcope.plans.config import TYPES, Source
from toposcope.sources.splits import csv_records, json_objects


def delimited(spark: SparkSession, source: Source, path: str | None = None) -> DataFrame:
    """Declared columns, read as text and cast; short rows are padded with null.

    quote="" turns quoting and escaping off.  skip_rows leaves out the first lines of
    each file.  Files are read in splits, also where quoted fields hold line ends or lines
    are skipped (sources/splits.py).
    """
    path = path or source.path
    text = T.StructType([T.StructField(a.name, T.StringType()) for a in source.attributes])
    options = {"sep": source.delimiter, "mode": "PERMISSIVE"}
    if source.quote == "":
        options |= {"quote": "\u0000", "escape": "\u0000"}
    elif source.quote:
        options |= {"quote": source.quote, "escape": source.quote}
    if not source.quote and source.skip_rows < 2:  # one skipped line is read as a header
        rows = spark.read.schema(text).options(**options, header=str(source.skip_rows == 1).lower(), enforceSchema="true").csv(path)
    else:
        declared = ", ".join(f"`{a.name}` string" for a in source.attributes)
        rows = csv_records(spark, path, source.quote, source.skip_rows).select(F.from_csv("value", declared, options).alias("r")).select("r.*")
    return rows.select(*[F.col(a.name).cast(TYPES[a.type]).alias(a.name) for a in source.attributes])


@F.pandas_udf(T.BinaryType())
def _from_geojson(raw: pd.Series) -> pd.Series:
    codes = {v: k for k, v in geo.NAMES.items()}

    def one(g: dict) -> tuple[int, object]:
        kind = codes[g["type"]]
        return kind, [one(x) for x in g["geometries"]] if kind == geo.COLLECTION else g["coordinates"]

    def cut(c):
        return [cut(x) for x in c] if c and isinstance(c[0], list) else c[:2]

    def bytes_of(text: str | None) -> bytes | None:
        if text is None or text == "null":
            return None
        kind, coordinates = one(json.loads(text))
        return geo.write_wkb(kind, coordinates if kind == geo.COLLECTION else cut(coordinates))

    return raw.map(bytes_of)


def geojson(spark: SparkSession, source: Source, path: str | None = None) -> DataFrame:
    """Features of a collection: declared properties and the geometry as WKB.

    The file is split anywhere; its features are the objects one level down that say so.
    """
    plain = [a for a in source.attributes if a.type != "geometry"]
    features = json_objects(spark, path or source.path).select(F.col("value").alias("f")).where(F.get_json_object("f", "$.type") == "Feature")
    cols = [F.get_json_object("f", f"$.properties.{a.name}").cast(TYPES[a.type]).alias(a.name) for a in plain]
    return features.select(*cols, _from_geojson(F.get_json_object("f", "$.geometry")).alias("geometry"))


class _Shape(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _ShapeReader(DataSourceReader):
    """Records of a .shp and its .dbf, a range of records to a task through the .shx index."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"].removeprefix("file://").removesuffix(".shp")

    def partitions(self):
        with open(self.path + ".shx", "rb") as f:
            n = (int.from_bytes(f.read(100)[24:28], "big") * 2 - 100) // 8
        step = max(1, -(-n // 64))
        return [_Shape(i, min(n, i + step)) for i in range(0, n, step)] or [_Shape(0, 0)]

    def read(self, part: _Shape):
        with open(self.path + ".shx", "rb") as x, open(self.path + ".shp", "rb") as s, open(self.path + ".dbf", "rb") as d:
            head = d.read(32)
            start, width = struct.unpack("<HH", head[8:12])
            fields = [d.read(32) for _ in range((start - 33) // 32)]
            names = [f[:11].split(b"\0")[0].decode() for f in fields]
            ends = [1]
            for f in fields:
                ends.append(ends[-1] + f[16])
            for i in range(part.first, part.last):
                x.seek(100 + 8 * i)
                s.seek(int.from_bytes(x.read(4), "big") * 2)
                raw = s.read(8 + int.from_bytes(x.read(4), "big") * 2)[8:]
                d.seek(start + width * i)
                record = d.read(width)
                values = {n: record[a:b].decode("utf-8", "replace").strip() for n, a, b in zip(names, ends, ends[1:], strict=False)}
                values |= {"OGC_FID": str(i)}
                yield tuple(shape_wkb(raw) if f.name == "geometry" else self._typed(values.get(f.name), f.dataType) for f in self.schema.fields)

    @staticmethod
    def _typed(value: str | None, kind: T.DataType):
        if not value:
            return None
        return int(float(value)) if isinstance(kind, T.LongType) else float(value) if isinstance(kind, T.DoubleType) else value


def shape_wkb(raw: bytes) -> bytes | None:
    """A shape record as WKB: points, lines and polygons, with or without further dimensions."""
    (kind,) = struct.unpack_from("<i", raw)
    kind %= 10
    if kind == 0:
        return None
    if kind == 1:
        return geo.write_wkb(geo.POINT, struct.unpack_from("<2d", raw, 4))
    if kind == 8:
        (n,) = struct.unpack_from("<i", raw, 36)
        return geo.write_wkb(geo.MULTIPOINT, [struct.unpack_from("<2d", raw, 40 + 16 * i) for i in range(n)])
    parts, n = struct.unpack_from("<2i", raw, 36)
    at = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    points = [struct.unpack_from("<2d", raw, 44 + 4 * parts + 16 * i) for i in range(n)]
    rings = [points[a:b] for a, b in zip(at, at[1:], strict=False)]
    if kind == 3:
        return geo.write_wkb(geo.LINE, rings[0]) if parts == 1 else geo.write_wkb(geo.MULTILINE, rings)
    polygons: list = []
    for ring in rings:  # outer rings run clockwise, their holes follow
        area = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:], strict=False))
        if area > 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return geo.write_wkb(geo.POLYGON, polygons[0]) if len(polygons) == 1 else geo.write_wkb(geo.MULTIPOLYGON, polygons)


class ShapeFile(DataSource):
    """spark.read.format("toposcope_shape").schema(...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "toposcope_shape"

    def schema(self) -> str:
        return "OGC_FID bigint, geometry binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShapeReader(schema, self.options)


class _PackageReader(DataSourceReader):
    """Rows of a GeoPackage layer, a range of row ids to a task."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.layer = schema, options["path"].removeprefix("file://"), options["layer"]

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            (top,) = db.execute(f'SELECT max(rowid) FROM "{self.layer}"').fetchone()
        step = max(1, -(-(top or 0) // 64))
        return [_Shape(i, i + step) for i in range(0, (top or 0) + 1, step)]

    def read(self, part: _Shape):
        with self._open() as db:
            (column,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.layer,)).fetchone()
            cols = ", ".join(f'"{column}"' if f.name == "geometry" else f'"{f.name}"' for f in self.schema.fields)
            for row in db.execute(f'SELECT {cols} FROM "{self.layer}" WHERE rowid >= ? AND rowid < ?', (part.first, part.last)):
                yield tuple(package_wkb(v) if f.name == "geometry" else v for v, f in zip(row, self.schema.fields, strict=True))


def package_wkb(raw: bytes | None) -> bytes | None:
    """The WKB behind a GeoPackage geometry header; null if empty."""
    if raw is None or raw[3] & 0x10:
        return None
    return raw[8 + (0, 32, 48, 48, 64)[raw[3] >> 1 & 7] :]


class GeoPackage(DataSource):
    """spark.read.format("toposcope_gpkg").schema(...).option("layer", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "toposcope_gpkg"

    def schema(self) -> str:
        raise ValueError("a GeoPackage needs a declared schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PackageReader(schema, self.options)


def spatial(spark: SparkSession, source: Source, path: str | None = None, crs: str = "EPSG:4326") -> DataFrame:
    """A spatial source in the gazetteer's CRS."""
    path = path or source.path
    schema = T.StructType([T.StructField(a.name, T._parse_datatype_string(TYPES[a.type])) for a in source.attributes])
    if path.endswith((".geojson", ".json")):
        df = geojson(spark, source, path)
    else:
        spark.dataSource.register(ShapeFile)
        spark.dataSource.register(GeoPackage)
        kind = "toposcope_gpkg" if path.endswith(".gpkg") else "toposcope_shape"
        df = spark.read.format(kind).schema(schema).options(layer=source.layer or "", path=path).load()
    return projections.reproject(df, source.crs, crs) if source.crs and source.crs != crs else df


def load(spark: SparkSession, source: Source, path: str | None = None, crs: str = "EPSG:4326") -> DataFrame:
    return delimited(spark, source, path) if source.tabular else spatial(spark, source, path, crs)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (id, text): strict UTF-8, with the file's name as id."""
    raw = spark.read.format("binaryFile").load(path)
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("id"), body.alias("text"))


ANNOTATIONS = "gazetteer string, documents array<struct<text:string, toponyms:array<struct<start:int,end:int,loc_id:string>>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(gazetteer, document, text, start, end, loc_id) of an annotation file; documents without toponyms have nulls."""
    raw = spark.read.schema(ANNOTATIONS).option("multiLine", "true").json(path)
    docs = raw.select("gazetteer", F.posexplode("documents").alias("document", "d"))
    return docs.select("gazetteer", "document", "d.text", F.explode_outer("d.toponyms").alias("t")).select("gazetteer", "document", "text", "t.*")
