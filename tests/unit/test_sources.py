import json
import struct

from pyspark.sql import functions as F

from toposcope.functions import geo, projections
from toposcope.plans.config import Source
from toposcope.sources import corpora, sinks, tables


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text('head\n1\tSay "hi"\t2.5\n2\tshort\n')
    attr = [{"name": "id", "type": "integer"}, {"name": "name", "type": "text"}, {"name": "v", "type": "real"}]
    s = Source("a", attr, path=f"file://{tmp_path}/a.txt", delimiter="\t", quote="", skip_rows=1)
    assert [tuple(r) for r in tables.load(spark, s).orderBy("id").collect()] == [(1, 'Say "hi"', 2.5), (2, "short", None)]
    (tmp_path / "b.txt").write_text('1,"a,b",\n2,c\n')
    s = Source("b", attr, path=f"file://{tmp_path}/b.txt", delimiter=",", quote='"')
    assert [tuple(r) for r in tables.load(spark, s).orderBy("id").collect()] == [(1, "a,b", None), (2, "c", None)]


def test_geojson_and_projection(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 7}, "geometry": {"type": "Point", "coordinates": [10, 50, 3]}}, {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "x.geojson").write_text(json.dumps(f))
    s = Source("x", [{"name": "n", "type": "integer"}, {"name": "geometry", "type": "geometry"}], path=f"file://{tmp_path}/x.geojson")
    rows = tables.load(spark, s).collect()
    assert rows[0].n == 7 and geo.parse_wkb(bytes(rows[0].geometry)) == (geo.POINT, (10.0, 50.0)) and rows[1].geometry is None
    df = projections.reproject(projections.reproject(tables.load(spark, s), "EPSG:4326", "EPSG:3857"), "EPSG:3857", "EPSG:4326")
    assert abs(geo.parse_wkb(bytes(df.first().geometry))[1][1] - 50) < 1e-9


def test_shapefile(spark, tmp_path):
    records = [struct.pack("<i2d", 1, 1.0, 2.0), struct.pack("<i", 0)]
    shp, shx, at = b"", b"", 50
    for i, r in enumerate(records):
        shx += struct.pack(">2i", at, len(r) // 2)
        shp += struct.pack(">2i", i + 1, len(r) // 2) + r
        at += 4 + len(r) // 2
    for name, body in (("shp", shp), ("shx", shx)):
        (tmp_path / f"p.{name}").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8) + body)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "p.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 65, 6) + field + b"\r" + b" abc  " + b" de   ")
    s = Source("p", [{"name": "NAME", "type": "text"}, {"name": "geometry", "type": "geometry"}], path=f"{tmp_path}/p.shp")
    rows = sorted(tables.load(spark, s).collect())
    assert [r.NAME for r in rows] == ["abc", "de"] and geo.parse_wkb(bytes(rows[0].geometry)) == (geo.POINT, (1.0, 2.0)) and rows[1].geometry is None


def test_annotations_and_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"gazetteer": "g", "documents": [{"text": "Paris", "toponyms": [{"start": 0, "end": 5, "loc_id": "1"}]}, {"text": "x", "toponyms": []}]}))
    assert [(r.document, r.start, r.loc_id) for r in tables.annotations(spark, f"file://{tmp_path}/a.json").orderBy("document").collect()] == [(0, 0, "1"), (1, None, None)]
    assert tables.texts(spark, f"file://{tmp_path}/a.json").first().id == "a.json"


def test_corpora(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<articles><article><source>u</source><text>In Rome now</text><locations><location><name>Rome</name><start>4</start><end>8</end><lat>41.9</lat><lon>12.5</lon></location><location><name>Oslo</name><start>1</start><end>3</end></location></locations></article></articles>")
    r = corpora.geovirus(spark, f"file://{tmp_path}/v.xml").first()
    assert r.text == "In Rome now" and [(g.start, g.end, g.name) for g in r.gold] == [(3, 7, "Rome")]
    lines = ["TOKEN\tNE-COARSE-LIT", "# hipe2022:document_id = d1"] + [f"{t}\t{b}\t_\t_\t_\t_\t_\t{q}\t_\t{m}" for t, b, q, m in (("In", "O", "_", "_"), ("New", "B-loc", "Q60", "_"), ("York", "I-loc", "Q60", "NoSpaceAfter"), (".", "O", "_", "_"))]
    (tmp_path / "h.tsv").write_text("\n".join(lines))
    at = spark.createDataFrame([("Q60", 40.7, -74.0)], "qid string, latitude double, longitude double")
    r = corpora.hipe(spark, f"file://{tmp_path}/h.tsv", at).first()
    assert r.text == "In New York." and [(g.start, g.end, g.name, g.latitude) for g in r.gold] == [(3, 11, "New York", 40.7)]
    w = corpora.wikiann(spark.createDataFrame([(1, ["in", "New", "York", "Oslo"], [0, 5, 6, 5]), (2, ["Rome"], [6]), (3, ["x"], [0])], "id int, tokens array<string>, ner_tags array<int>"))
    assert {r.id: (r.spans, r.orphans) for r in w.collect()} == {1: ([(3, 11), (12, 16)], 0), 2: ([(0, 4)], 1), 3: ([], 0)}


def test_problems_and_sinks(spark):
    rows = [("a", "Rome x", [(0, 4, "Rome", 1.0, 1.0), (0, 4, "Rome", 1.0, 1.0), (2, 6, "me x", None, None)]), ("b", "x", []), ("b", "x", [(0, 9, "x", 99.0, 0.0)])]
    found = {(r.identifier, r.problem) for r in corpora.problems(spark.createDataFrame(rows, corpora.CORPUS)).collect()}
    assert found == {("a", "duplicate span"), ("a", "overlapping span"), ("b", "missing gold"), ("b", "duplicate document"), ("b", "offset"), ("b", "coordinate")}
    docs = spark.createDataFrame([("a", "Rome")], "id string, text string")
    view = spark.createDataFrame([("a", 0, 4, "Rome", None)], "document_id string, start int, end int, text string, feature_identifier string")
    assert json.loads(sinks.document_json(docs, view).first().value)["references"][0]["text"] == "Rome"
    f = sinks.geojson_features(spark.range(2).select(F.col("id").alias("key"), F.lit(None).cast("string").alias("geometry_json"), F.struct("id").alias("properties")))
    assert len(json.loads(sinks.geojson_collection(f).first().value)["features"]) == 2
    assert sinks.differences({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"] and "<rect" in sinks.bar_chart({"x": 0.5})


def test_dropped_spans_and_first_claims(spark, tmp_path):
    spans = [{"start": 0, "end": 5, "LOC": "Paris", "lat": 1.0, "lon": 2.0}, {"start": 2, "end": 5, "LOC": "Rome", "lat": 1.0, "lon": 2.0}]
    (tmp_path / "n.json").write_text(json.dumps({"b": {"text": "Paris", "spans": spans}, "a": {"text": "x", "spans": []}}))
    got = {r.identifier: r for r in corpora.newsli(spark, f"file://{tmp_path}/n.json").collect()}
    assert [g.name for g in got["b"].gold] == ["Paris"] and got["b"].dropped == 1 and got["a"].dropped == 0
    claims = spark.createDataFrame([("Q1", 2, 9.0, 9.0), ("Q1", 1, 1.0, 2.0)], "qid string, pos int, latitude double, longitude double")
    first = {r.qid: (r.latitude, r.longitude) for r in corpora.first_coordinates(claims, spark.createDataFrame([("Q1",), ("Q2",), ("Q1",)], "qid string")).collect()}
    assert first == {"Q1": (1.0, 2.0), "Q2": (None, None)}


def test_places_in_wgs84(spark):
    df = spark.createDataFrame([(geo.MERCATOR_M * 3.141592653589793, 0.0)], "x double, y double")
    r = sinks.wgs84(df, "EPSG:3857").first()
    assert abs(r.longitude - 180) < 1e-9 and abs(r.latitude) < 1e-9 and sinks.wgs84(df, "EPSG:4326").first().longitude == df.first().x


def test_skipped_header_lines(spark, tmp_path):
    attr = [{"name": "id", "type": "integer"}, {"name": "name", "type": "text"}]
    for skip, head in ((1, "a\tb\n"), (2, "x\ny\n")):
        (tmp_path / f"h{skip}.txt").write_text(head + "1\tone\n2\ttwo\n")
        s = Source("h", attr, path=f"file://{tmp_path}/h{skip}.txt", delimiter="\t", quote="", skip_rows=skip)
        assert [tuple(r) for r in tables.load(spark, s).orderBy("id").collect()] == [(1, "one"), (2, "two")]


def test_corpus_digest(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("b", None)], "identifier string, text string")
    one = corpora.digest(df)
    assert one == corpora.digest(df.select("text", "identifier").repartition(3)) and len(one) == 64
    assert one != corpora.digest(df.distinct()) and one != corpora.digest(df.where("text is null"))


def test_known_absences_are_not_asked_again(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"Q1": [1.5, 2.5], "Q2": null}')
    cache = corpora.coordinates(spark, f"file://{tmp_path}/c.json")
    assert {(r.qid, r.latitude) for r in cache.collect()} == {("Q1", 1.5), ("Q2", None)}
    asked = corpora.to_ask(spark.createDataFrame([("Q1",), ("Q2",), ("Q3",), ("Q3",), (None,)], "qid string"), cache)
    assert [r.qid for r in asked.collect()] == ["Q3"]
