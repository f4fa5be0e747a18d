from pyspark.sql import functions as F

from toposcope.functions import geo


def box(x, y, w, h):
    return geo.write_wkb(geo.POLYGON, [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]])


def test_points_are_merged_as_before():
    points = [geo.write_wkb(geo.POINT, p) for p in [(3.0, 1.0), (-2.0, 5.0), (3.0, 1.0)]]
    assert geo.merge(points) == geo.write_wkb(geo.MULTIPOINT, [(-2.0, 5.0), (3.0, 1.0)])
    assert geo.merge(points[:1]) == points[0]


def test_keys_of_too_few_rows_are_left_out(spark):
    rows = [("a", box(0, 0, 2, 2)), ("a", None), ("b", box(0, 0, 1, 1)), ("c", None), ("c", None)]
    got = geo.merged(spark.createDataFrame(rows, "key string, shape binary"), "key", "shape", least=2)
    assert {r["key"] for r in got.collect()} == {"a"}


def test_hot_key_is_merged_in_groups_of_neighbours(spark):
    rows = [("hot", box(i % 30 * 2.0, i // 30 * 2.0, 2.0, 2.0)) for i in range(900)] + [("cold", box(0.0, 0.0, 1.0, 1.0))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = geo.merged(spark.createDataFrame(rows, "key string, shape binary"), "key", "shape").select("key", geo.st_area("geometry").alias("a"), "geometry")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= geo.GROUPS_AT_ONCE
    areas = {r["key"]: (r["a"], bytes(r["geometry"])) for r in got.collect()}
    assert areas["hot"][0] == 3600.0 and areas["cold"][0] == 1.0
    # one square is left, without the borders between the groups
    assert len(areas["hot"][1]) == len(box(0, 0, 60, 60))


def test_rectangles_need_no_test_in_python_and_full_cells_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(geo, "CELL_ROWS", 3)
    boxes = [(i % 7 * 3.0, i % 5 * 2.0, 1.0 + i % 4, 1.0 + i % 3) for i in range(40)]
    a = spark.createDataFrame([(i, box(*b)) for i, b in enumerate(boxes)], "i int, shape binary")
    b = a.select(F.col("i").alias("j"), F.col("shape").alias("other"))
    found = geo.geometry_join(a, b, "intersects")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "__share" in plan
    touch = lambda p, q: p[0] <= q[0] + q[2] and q[0] <= p[0] + p[2] and p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3]
    want = {(i, j) for i, p in enumerate(boxes) for j, q in enumerate(boxes) if touch(p, q)}
    got = [(r["i"], r["j"]) for r in found.select("i", "j").collect()]
    assert len(got) == len(want) and {*got} == want


def test_other_shapes_keep_their_exact_test(spark):
    triangle = geo.write_wkb(geo.POLYGON, [[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]])
    a = spark.createDataFrame([(0, triangle), (1, box(0.0, 0.0, 1.0, 1.0))], "i int, shape binary")
    b = spark.createDataFrame([(0, triangle), (1, box(8.0, 8.0, 1.0, 1.0)), (2, box(1.0, 1.0, 8.0, 8.0))], "j int, other binary")
    got = {(r["i"], r["j"]) for r in geo.geometry_join(a, b, "intersects").select("i", "j").collect()}
    assert got == {(0, 0), (0, 2), (1, 0), (1, 2)}


def test_long_thin_boxes_meet_few_others(spark, monkeypatch):
    wide = [(0.0, float(i), 1000.0, 1.0) for i in range(20)] + [(float(i), 0.0, 1.0, 1000.0) for i in range(20)]
    dots = [(i * 37 % 1009 + 0.5, i * 91 % 1013 + 0.5, 1.0 + i % 3, 1.0 + i % 5) for i in range(400)]
    a = spark.createDataFrame([(i, box(*b)) for i, b in enumerate(wide)], "i int, shape binary")
    b = spark.createDataFrame([(i, box(*b)) for i, b in enumerate(dots)], "j int, other binary")
    left, right = a.withColumn("__a", geo.st_box("shape")), b.withColumn("__b", geo.st_box("other"))
    ups, downs = geo._levels(left, "__a"), geo._levels(right, "__b")
    cells = geo._in_cells(left, "__a", downs, 0).join(geo._in_cells(right, "__b", ups, 0), ["__lx", "__ly", "__cx", "__cy"])
    touch = lambda p, q: p[0] <= q[0] + q[2] and q[0] <= p[0] + p[2] and p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3]
    want = sorted((i, j) for i, p in enumerate(wide) for j, q in enumerate(dots) if touch(p, q))
    # in square cells every wide box met all 400 of the others
    assert len(want) < cells.count() < len(wide) * len(dots) / 8
    for kinds in (128, 4):
        monkeypatch.setattr(geo, "MOST_KINDS", kinds)
        assert sorted(map(tuple, geo.geometry_join(a, b, "intersects").select("i", "j").collect())) == want
