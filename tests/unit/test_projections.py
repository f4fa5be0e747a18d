import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.functions import geo, projections as P


def dms(d, m, s):
    return d + m / 60 + s / 3600


def metres(lon1, lat1, lon2, lat2):
    return math.hypot((lon2 - lon1) * math.cos(math.radians(lat1)), lat2 - lat1) * 111_195


#: published control points: code, x, y, longitude, latitude (WGS 84), metres
CONTROL = [
    ("EPSG:2056", 2_600_000, 1_200_000, 7.438632495, 46.951082877, 0.5),
    ("EPSG:21781", 600_000, 200_000, 7.438632495, 46.951082877, 0.5),
    ("EPSG:2056", 2_700_000, 1_100_000, dms(8, 43, 49.79), dms(46, 2, 38.87), 1.0),
    ("EPSG:21781", 700_000, 100_000, dms(8, 43, 49.79), dms(46, 2, 38.87), 1.0),
    ("EPSG:32617", 630_084, 4_833_438, -dms(79, 23, 13.7), dms(43, 38, 33.24), 1.0),
    ("EPSG:3857", 20_037_508.342789244, 0, 180.0, 0.0, 0.01),
]


@pytest.mark.parametrize(("code", "x", "y", "lon", "lat", "most"), CONTROL)
def test_control_points(code, x, y, lon, lat, most):
    (u,), (v,) = P.transformer(code, "EPSG:4326")(np.array([float(x)]), np.array([float(y)]))
    assert metres(lon, lat, u, v) < most
    (e,), (n,) = P.transformer("EPSG:4326", code)(np.array([lon]), np.array([lat]))
    assert math.hypot(e - x, n - y) < most


def test_worked_example_of_the_british_grid():
    """On its own datum, to a millimetre: 52 39 27.2531 N, 1 43 4.5177 E."""
    grid = P.system("EPSG:27700")[1]
    (e,), (n,) = grid.forward(np.array([dms(1, 43, 4.5177)]), np.array([dms(52, 39, 27.2531)]))
    assert abs(e - 651_409.903) < 2e-3 and abs(n - 313_177.270) < 2e-3


def test_worked_example_of_the_swiss_projection():
    """On its own datum: the Rigi."""
    (e,), (n,) = P.system("EPSG:21781")[1].forward(np.array([dms(8, 29, 11.11127)]), np.array([dms(47, 3, 28.95659)]))
    assert abs(e - 679_520.05) < 0.02 and abs(n - 212_273.44) < 0.02


@pytest.mark.parametrize(("code", "west", "east", "south", "north"), [("EPSG:2056", 5.9, 10.5, 45.8, 47.9), ("EPSG:21781", 5.9, 10.5, 45.8, 47.9), ("EPSG:27700", -8, 2, 50, 61), ("EPSG:32633", 12, 18, 0, 84), ("EPSG:32733", 12, 18, -80, 0), ("EPSG:25832", 6, 12, 36, 72), ("EPSG:32601", 175, 185, -10, 80), ("EPSG:3857", -180, 180, -85, 85), ("EPSG:4258", -180, 180, -90, 90)])
def test_round_trips(code, west, east, south, north):
    lon, lat = (v.ravel() for v in np.meshgrid(np.linspace(west, east, 23)[:-1], np.linspace(south, north, 19)))
    x, y = P.transformer("EPSG:4326", code)(lon, lat)
    u, v = P.transformer(code, "EPSG:4326")(x, y)
    # heights are dropped on the way, so a change of datum loses some micrometres
    assert np.abs((u - lon + 180) % 360 - 180).max() * 111_195 < 2e-2 and np.abs(v - lat).max() * 111_195 < 2e-2


def test_unknown_codes():
    for code in ("EPSG:9999", "EPSG:32661", "EPSG:25801", "2056", ""):
        with pytest.raises(ValueError, match="no projection"):
            P.transformer(code, "EPSG:4326")


def test_all_geometries_move_and_nulls_stay(spark):
    ring = [(7.0, 46.0), (8.0, 46.0), (8.0, 47.0), (7.0, 46.0)]
    shapes = [(geo.POINT, ring[0]), (geo.LINE, ring), (geo.POLYGON, [ring]), (geo.MULTIPOLYGON, [[ring], [ring]]), (geo.COLLECTION, [(geo.POINT, ring[1]), (geo.MULTILINE, [ring])])]
    df = spark.createDataFrame([(i, geo.write_wkb(*s)) for i, s in enumerate(shapes)] + [(-1, None)], "id int, geometry binary")
    there = P.reproject(df, "EPSG:4326", "EPSG:2056")
    back = {r.id: r.geometry for r in P.reproject(there, "EPSG:2056", "EPSG:4326").collect()}
    assert back.pop(-1) is None
    for i, (kind, c) in enumerate(shapes):
        k, d = geo.parse_wkb(back[i])
        assert k == kind and np.allclose(np.array(geo._points(k, d)), np.array(geo._points(kind, c)), atol=1e-7)
    geo.register(spark)
    df.createOrReplaceTempView("shapes_to_move")
    got = spark.sql("SELECT id, ST_Transform(geometry, IF(id = 1, null, 'EPSG:4326'), 'EPSG:2056') AS g FROM shapes_to_move").collect()
    want = {r.id: r.geometry for r in there.collect()}
    assert {r.id: r.g for r in got} == {**want, 1: None}
    xy = spark.createDataFrame([(2_600_000.0, 1_200_000.0), (None, 1.0)], "x double, y double").select(P.project(F.col("x"), F.col("y"), "EPSG:2056", "EPSG:4326").alias("p")).collect()
    assert abs(xy[0].p.x - 7.438632495) < 1e-6 and xy[1].p is None


def test_a_national_source_is_built_in_world_coordinates(spark, tmp_path):
    """A source that declares EPSG:2056, as a national names file does, in a gazetteer of EPSG:4326."""
    from toposcope.plans.config import Attribute, Source
    from toposcope.sources import tables

    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "Bern"}, "geometry": {"type": "Point", "coordinates": [2_600_000.0, 1_200_000.0]}}]}
    (tmp_path / "names.geojson").write_text(json.dumps(body))
    source = Source("names", [Attribute("NAME", "text"), Attribute("geometry", "geometry")], path=f"file://{tmp_path}/names.geojson", crs="EPSG:2056")
    row = tables.load(spark, source).first()
    x, y = geo.parse_wkb(bytes(row.geometry))[1]
    assert row.NAME == "Bern" and abs(x - 7.438632495) < 1e-6 and abs(y - 46.951082877) < 1e-6
