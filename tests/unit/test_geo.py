import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toposcope.functions import geo, overlay

RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def test_wkb_round_trips_and_predicates():
    for kind, c in [(geo.POINT, (1.0, 2.0)), (geo.LINE, RING), (geo.POLYGON, [RING, HOLE]), (geo.MULTIPOINT, RING), (geo.MULTIPOLYGON, [[RING]]), (geo.COLLECTION, [(geo.POINT, (1.0, 2.0))])]:
        assert geo.parse_wkb(geo.write_wkb(kind, c)) == (kind, c)
    assert geo.inside(3, 3, geo.POLYGON, [RING, HOLE]) and not geo.inside(1.5, 1.5, geo.POLYGON, [RING, HOLE]) and not geo.inside(5, 5, geo.POLYGON, [RING])
    assert geo.centroid_of(geo.POLYGON, [RING]) == (2.0, 2.0)
    p = [geo.write_wkb(geo.POINT, c) for c in ((2.0, 2.0), (1.0, 1.0), (1.0, 1.0))]
    assert geo.parse_wkb(geo.merge(p)) == (geo.MULTIPOINT, [(1.0, 1.0), (2.0, 2.0)])
    assert geo.merge([None]) is None and geo.merge(p[1:]) == p[1]


@settings(max_examples=100, deadline=None)
@given(st.floats(-180, 180), st.floats(-90, 90))
def test_merged_point_is_itself(x, y):
    raw = geo.write_wkb(geo.POINT, (x, y))
    assert geo.merge([raw, raw]) == raw


def test_spark_functions(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (48.85, 2.35, 48.85, 2.35)], "a double, b double, c double, d double")
    km = [r[0] for r in df.select(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert abs(km[0] - 3.141592653589793 * geo.EARTH_KM) < 1e-6 and km[1] == 0
    x, y = geo.to_mercator(F.lit(10.0), F.lit(50.0))
    lon, lat = geo.from_mercator(x, y)
    got = spark.range(1).select(lon, lat).first()
    assert abs(got[0] - 10) < 1e-9 and abs(got[1] - 50) < 1e-9
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 9.0, 9.0), (3, None, 1.0)], "id int, x double, y double")
    shapes = spark.createDataFrame([("sq", geo.write_wkb(geo.POLYGON, [RING]))], "name string, geometry binary")
    assert {r.id: r.name for r in geo.spatial_join(points, shapes, "left").collect()} == {1: "sq", 2: None, 3: None}
    c = shapes.select(geo.st_centroid("geometry").alias("c"), geo.geojson_geometry("geometry").alias("j")).first()
    assert (c.c.x, c.c.y) == (2.0, 2.0) and c.j.startswith('{"type": "Polygon"')


def shape(kind, c):
    return geo.write_wkb(kind, c)


def test_relations():
    square, holed, line = (geo.POLYGON, [RING]), (geo.POLYGON, [RING, HOLE]), (geo.LINE, [(1.0, 1.5), (3.0, 1.5)])
    small = (geo.POLYGON, [[(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5), (2.5, 2.5)]])
    around = (geo.POLYGON, [[(0.5, 0.5), (3.0, 0.5), (3.0, 3.0), (0.5, 3.0), (0.5, 0.5)]])
    far = (geo.POLYGON, [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]])
    assert geo.within((geo.POINT, (3.0, 3.0)), square) and not geo.within((geo.POINT, (0.0, 2.0)), square) and not geo.within((geo.POINT, (1.5, 1.5)), holed)
    assert geo.within(line, square) and not geo.within(line, holed) and geo.within(small, holed) and geo.within(square, square)
    assert geo.within(around, square) and not geo.within(around, holed) and not geo.within(square, around)
    assert geo.intersects(line, holed) and geo.intersects((geo.POINT, (0.0, 2.0)), square) and not geo.intersects(far, square)
    assert geo.intersects((geo.LINE, [(-1.0, 2.0), (5.0, 2.0)]), square) and geo.intersects(around, small)
    for text, want in (("POINT (1 2)", (geo.POINT, (1.0, 2.0))), ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", square), ("MULTIPOINT(1 2, 3 4)", (geo.MULTIPOINT, [(1.0, 2.0), (3.0, 4.0)])), ("LINESTRING Z (0 0 5, 1 1 5)", (geo.LINE, [(0.0, 0.0), (1.0, 1.0)]))):
        assert geo.parse_wkb(geo.from_text(text)) == want


def test_geometry_join_equals_brute_force(spark):
    import random

    rng = random.Random(4)

    def box(x, y, w, h):
        return (geo.POLYGON, [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])

    areas = [box(rng.randrange(0, 40), rng.randrange(0, 40), rng.randrange(1, 12), rng.randrange(1, 12)) for _ in range(40)]
    shapes = [(geo.POINT, (float(rng.randrange(0, 50)), float(rng.randrange(0, 50)))) for _ in range(60)] + [box(rng.randrange(0, 45), rng.randrange(0, 45), 2, 3) for _ in range(30)]
    a = spark.createDataFrame([(i, shape(*s)) for i, s in enumerate(shapes)] + [(-1, None)], "id int, shape binary")
    b = spark.createDataFrame([(i, shape(*s)) for i, s in enumerate(areas)] + [(-1, None)], "key int, other binary")
    for name, test in geo.PREDICATES.items():
        got = sorted((r.id, r.key) for r in geo.geometry_join(a, b, name).collect())
        assert got == sorted((i, k) for i, s in enumerate(shapes) for k, t in enumerate(areas) if test(s, t)), name


def _box(x, y, w=1.0, h=1.0):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


def test_union_takes_shared_borders_away():
    def union(*polygons):
        return geo.parse_wkb(geo.merge([geo.write_wkb(geo.POLYGON, p) for p in polygons]))

    kind, c = union(_box(0.0, 0.0), _box(1.0, 0.0))
    assert kind == geo.POLYGON and set(c[0]) == {(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)} and len(c) == 1
    # eight of nine fields leave a hole
    kind, c = union(*[_box(float(i % 3), float(i // 3)) for i in range(9) if i != 4])
    assert kind == geo.POLYGON and len(c) == 2 and set(c[1]) == {(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)}
    assert not geo.inside(1.5, 1.5, kind, c) and geo.inside(0.5, 1.5, kind, c)
    assert geo.centroid_of(kind, c) == (1.5, 1.5)
    # a filled hole, parts that touch nothing, and overlaps
    assert union([_box(0.0, 0.0, 4.0, 4.0)[0], _box(1.0, 1.0)[0]], _box(1.0, 1.0))[0] == geo.POLYGON
    assert union(_box(0.0, 0.0), _box(5.0, 5.0))[0] == geo.MULTIPOLYGON
    for pair, area in (((_box(0.0, 0.0, 2.0, 2.0), _box(1.0, 1.0, 2.0, 2.0)), 7.0), ((_box(0.0, 1.0, 3.0, 1.0), _box(1.0, 0.0, 1.0, 3.0)), 5.0)):
        one = union(*pair)
        assert one[0] == geo.POLYGON and geo.area_of(*one) == area
    assert union(_box(0.0, 0.0), _box(0.0, 0.0))[0] == geo.POLYGON


def test_random_unions_cover_what_their_parts_cover():
    import random

    rng = random.Random(1)
    for _ in range(60):
        boxes = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(1, 14))]
        got = overlay.union([_box(*map(float, b)) for b in boxes])
        cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
        assert abs(geo.area_of(geo.MULTIPOLYGON, got) - len(cells)) < 1e-9
        assert all(sum(geo.inside(i + 0.5, j + 0.5, geo.POLYGON, p) for p in got) == ((i, j) in cells) for i in range(18) for j in range(18))
    for _ in range(60):
        stars = []
        for _ in range(rng.randrange(2, 9)):
            cx, cy, k = rng.random() * 10, rng.random() * 10, rng.randrange(5, 12)
            ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in (2 * math.pi * i / k for i in range(k)) for r in [1 + 2 * rng.random()]]
            stars.append([[*ring, ring[0]][:: rng.choice((1, -1))]])
        got = overlay.union(stars)
        for _ in range(100):
            x, y = rng.random() * 14 - 2, rng.random() * 14 - 2
            assert sum(geo.inside(x, y, geo.POLYGON, p) for p in got) == any(geo.inside(x, y, geo.POLYGON, p) for p in stars)


def test_unions_at_corners_and_of_odd_input():
    two = overlay.union([_box(0.0, 0.0), _box(1.0, 1.0)])  # they meet in a corner and stay two
    assert len(two) == 2 and all(len(p) == 1 and len(p[0]) == 5 for p in two)
    ring = [_box(0.0, 0.0, 3.0, 1.0), _box(0.0, 2.0, 3.0, 1.0), _box(0.0, 0.0, 1.0, 3.0), _box(2.0, 0.0, 1.0, 3.0)]
    (frame,) = overlay.union(ring)
    assert len(frame) == 2 and geo.area_of(geo.POLYGON, frame) == 8
    # an island in the hole of another, the hole filled by parts, a flat ring, nothing at all
    assert len(overlay.union([*ring, _box(1.25, 1.25, 0.5, 0.5)])) == 2
    assert [len(p) for p in overlay.union([*ring, _box(0.5, 0.5, 1.0, 2.0), _box(1.5, 0.5, 1.0, 2.0)])] == [1]
    assert overlay.union([[[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]) == [] == overlay.union([])
    assert geo.area_of(geo.MULTIPOLYGON, overlay.union([_box(1e6, 1e6, 1e-3, 1e-3), _box(1e6 + 5e-4, 1e6, 1e-3, 1e-3)])) == pytest.approx(1.5e-6, rel=1e-3)


def test_hot_key_is_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(geo, "MERGED", 4)
    rows = [("hot", geo.write_wkb(geo.POLYGON, _box(float(i % 20), float(i // 20), 1.5, 1.5))) for i in range(200)] + [("one", geo.write_wkb(geo.POLYGON, _box(0.0, 0.0))), ("none", None)]
    got = {r.k: geo.parse_wkb(r.geometry) for r in geo.merged(spark.createDataFrame(rows, "k string, shape binary"), "k", "shape").collect()}
    assert set(got) == {"hot", "one"} and geo.area_of(*got["hot"]) == 20.5 * 10.5 and got["hot"][0] == geo.POLYGON


def test_extents_of_any_ratio_give_few_rows(spark):
    def box(k, x, y, w, h):
        return (k, geo.write_wkb(geo.POLYGON, _box(x, y, w, h)))

    world = [box(0, -180.0, -90.0, 360.0, 180.0), box(1, 1e-9, 1e-9, 1e-9, 1e-9), box(2, 3.0, 3.0, 1e5, 1e-6)]
    small = [box(i, i % 30 - 15.0, i // 30 - 15.0, 4.0 ** -(i % 20), 1e-7) for i in range(900)] + [(900, geo.write_wkb(geo.POINT, (1.5e-9, 1.5e-9))), (901, geo.write_wkb(geo.POINT, (1e300, 1.0)))]
    a, b = spark.createDataFrame(world, "id int, shape binary"), spark.createDataFrame(small, "key int, other binary")
    boxed = a.withColumn("__a", geo.st_box("shape"))
    cells = geo._in_cells(boxed, "__a", geo._levels(b.withColumn("__b", geo.st_box("other")), "__b"), -30)
    assert max(r["count"] for r in cells.groupBy("id").count().collect()) < 100
    got = sorted((r.id, r.key) for r in geo.geometry_join(a, b, "intersects").collect())
    parse = lambda g: geo.parse_wkb(g)
    assert got == sorted((i, k) for i, s in world for k, t in small if geo.intersects(parse(s), parse(t))) and (1, 900) in got


def test_relations_of_many_points_are_those_of_one(spark):
    points = [geo.write_wkb(geo.POINT, (i / 2, j / 2)) for i in range(-1, 10) for j in range(-1, 10)]
    areas = [geo.write_wkb(geo.POLYGON, [RING, HOLE]), geo.write_wkb(geo.MULTIPOLYGON, [[RING], _box(3.0, 3.0, 1.5, 1.5)])]
    for name, test in geo.PREDICATES.items():
        for area in areas:
            pairs = [(area, p) for p in points] if name == "contains" else [(p, area) for p in points]
            a, b = [x for x, _ in pairs] + [None], [y for _, y in pairs] + [area]
            assert geo.related(name, a, b) == [test(geo.parse_wkb(x), geo.parse_wkb(y)) for x, y in pairs] + [None]
