import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from toposcope.functions import geo
from toposcope.plans.config import Source
from toposcope.sources import corpora, splits, tables


@pytest.fixture
def small_splits(spark):
    """Files of a few kB come in many splits."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "64")
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def many(spark, path, separator="\n"):
    return splits.records(spark, path, separator).select("split").distinct().count()


def test_prefixes_over_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(500)))
    path = f"file://{tmp_path}/a.txt"
    assert many(spark, path) >= 16
    rows = splits.records(spark, path).withColumn("v", F.col("value").cast("long"))
    got = splits.latest(splits.running(rows, F.col("v"), "before"), F.when(F.col("v") % 97 == 5, F.col("v")), "seen")
    for r in got.collect():
        assert r.before == sum(range(r.v)) and r.seen == max((x for x in range(r.v + 1) if x % 97 == 5), default=None)


@pytest.mark.parametrize("skip", [0, 2])
def test_quoted_line_ends_and_skipped_lines(spark, tmp_path, small_splits, skip):
    rnd = random.Random(skip)
    rows = [(str(i), "".join(rnd.choice(['a', '"', "\n", ";", "é", " "]) for _ in range(rnd.randrange(0, 30))) or "x", str(i / 2)) for i in range(200)]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n").writerows(rows)
    head = "".join(f'head "{i}\n' for i in range(skip))  # an odd quote in a skipped line opens nothing
    (tmp_path / "q.csv").write_text(head + out.getvalue(), encoding="utf-8", newline="")
    attributes = [{"name": "id", "type": "integer"}, {"name": "t", "type": "text"}, {"name": "v", "type": "real"}]
    path = f"file://{tmp_path}/q.csv"
    got = tables.delimited(spark, Source("q", attributes, path=path, delimiter=";", quote='"', skip_rows=skip)).collect()
    assert many(spark, path) >= 16
    # leading and trailing white space of quoted fields stays
    assert sorted((r.id, r.t, r.v) for r in got) == [(int(a), b, float(c)) for a, b, c in rows]


def test_plain_files_with_skipped_lines(spark, tmp_path, small_splits):
    (tmp_path / "p.txt").write_text("one\ntwo\n" + "".join(f"{i}\tname \"{i}\r\n" for i in range(300)), newline="")
    attributes = [{"name": "id", "type": "integer"}, {"name": "t", "type": "text"}]
    got = tables.delimited(spark, Source("p", attributes, path=f"file://{tmp_path}/p.txt", delimiter="\t", quote="", skip_rows=2)).collect()
    assert sorted((r.id, r.t) for r in got) == [(i, f'name "{i}') for i in range(300)]


@pytest.mark.parametrize("style", [{"indent": 2, "ensure_ascii": False}, {"separators": (",", ":")}])
def test_geojson_in_splits(spark, tmp_path, small_splits, style):
    rnd = random.Random(4)
    odd = lambda: "".join(rnd.choice(list('{}[]"\\,: aé\n')) for _ in range(rnd.randrange(0, 25)))
    shapes = [{"type": "Point", "coordinates": [1.5, 2.5]}, None, {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0.0, 1.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]}]}]
    features = [{"type": "Feature", "properties": {"n": i, "t": odd(), "more": {"deep": {"er": odd()}}}, "geometry": shapes[i % 3]} for i in range(80)]
    body = {"type": "FeatureCollection", "na{me": "}{", "crs": {"type": "name", "properties": {"name": "x}"}}, "features": features, "end": {"type": "Other"}}
    (tmp_path / "f.geojson").write_text(json.dumps(body, **style), encoding="utf-8")
    path = f"file://{tmp_path}/f.geojson"
    source = Source("f", [{"name": "n", "type": "integer"}, {"name": "t", "type": "text"}, {"name": "geometry", "type": "geometry"}], path=path)
    got = {r.n: r for r in tables.geojson(spark, source).collect()}
    assert many(spark, path, "}") >= 16
    assert {i: r.t for i, r in got.items()} == {f["properties"]["n"]: f["properties"]["t"] for f in features}
    for i, r in got.items():
        kind = shapes[i % 3]
        assert (r.geometry is None) == (kind is None)
        assert kind is None or geo.NAMES[geo.parse_wkb(bytes(r.geometry))[0]] == kind["type"]


def test_hipe_in_splits_equals_one_task(spark, tmp_path):
    rnd = random.Random(9)
    lines, want = ["TOKEN\tNE-COARSE-LIT"], {}
    for d in range(12):
        lines += ["", f"# hipe2022:document_id = d{d}", "# other"]
        text, spans = "", []
        for _ in range(rnd.randrange(1, 40)):
            token, label, glue = rnd.choice(["New", "York", "é", "in", "."]), rnd.choice(["O", "O", "B-loc", "I-loc", "b-LOC"]), rnd.random() < 0.3
            lines.append(f"{token}\t{label}\t_\t_\t_\t_\t_\tQ{len(spans)}\t_\t{'NoSpaceAfter' if glue else '_'}")
            is_loc = label.lower().endswith("loc")
            if is_loc and (label[0] in "Bb" or not (spans and spans[-1][2])):
                spans.append([len(text), len(text) + len(token), True])
            elif is_loc:
                spans[-1][1] = len(text) + len(token)
            elif spans:
                spans[-1][2] = False
            text += token + ("" if glue else " ")
        want[f"d{d}"] = (text.rstrip(), [(a, b) for a, b, _ in spans])
    (tmp_path / "h.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    path = f"file://{tmp_path}/h.tsv"
    read = lambda: {r.identifier: (r.text, [(g.start, g.end) for g in r.gold]) for r in corpora.hipe(spark, path).collect()}
    whole = read()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "128")
    try:
        assert many(spark, path) >= 16 and read() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert whole == want


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.geojson").write_text("")
    (tmp_path / "n.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    for name in ("e", "n"):
        assert splits.json_objects(spark, f"file://{tmp_path}/{name}.geojson").count() == 0
    assert splits.csv_records(spark, f"file://{tmp_path}/e.geojson", '"', 2).count() == 0
