import pytest
from pyspark.sql import functions as F

from toposcope.functions import geo
from toposcope.functions.text import edit_distance, letter_set, normal_form, soundex, tokens
from toposcope.operators import build, store
from toposcope.operators.search import Search, occurrences, ranked, search_one
from toposcope.plans import blocks
from toposcope.plans.config import Block, Config, ConfigError, Source, split_alias

ATTR = [{"name": "pid", "type": "text"}, {"name": "name", "type": "text"}]


def source(name, **more):
    return {"name": name, "path": "x", "delimiter": "\t", "attributes": ATTR, **more}


def test_config_rules():
    assert split_alias("src.a") == ("src.a", "a") and split_alias("a + 1 AS b") == ("a + 1", "b") and split_alias("f(a)") == ("f(a)", None)
    good = {"source": "s", "identifier": "pid", "names": ["name"]}
    Config("g", [source("s")], [good])
    for bad in (
        {"sources": [source("s"), source("s")]},
        {"features": [good, good]},
        {"features": [{**good, "source": "t"}]},
        {"features": [{**good, "names": []}]},
        {"features": [{**good, "data": ["f(a)"]}]},
        {"features": [{**good, "data": ["a", "b AS a"]}]},
        {"sources": [source("s", url="u")]},
        {"sources": [{**source("s"), "attributes": []}]},
        {"sources": [{**source("s"), "delimiter": None}]},
        {"sources": [source("s", sha256="12")]},
        {"name": "../x"},
    ):
        with pytest.raises(ConfigError):
            Config(**{"name": "g", "sources": [source("s")], "features": [good]} | bad)


def test_expression_rewrite():
    cols = ["name", "Count"]
    assert blocks.qualify("upper(name) || 'name' || t.name || \"name\" || count", cols) == "upper(src.`name`) || 'name' || t.name || \"name\" || src.`Count`"
    assert blocks.qualifiers("a.x + upper(b.y) + 'c.z'") == {"a", "b"} and blocks.bare_references("f(x) + a.y + 'z'") == ["x"]
    assert blocks.qualify_join("LEFT JOIN t ON name = t.name", cols) == "LEFT JOIN t ON src.`name` = t.name"
    assert blocks.qualify_join("JOIN t USING (name)", cols) == "JOIN t USING (name)"


@pytest.fixture(scope="module")
def peaks(spark):
    rows = [(1, "p1", "Piz A (north)", None, 1.0), (2, "p1", "Piz A", 800, 2.0), (3, "p1", "Alt", 700, 2.0), (4, "p2", "Berg", None, 3.0), (5, None, "No", 1, 1.0)]
    df = spark.createDataFrame(rows, f"{blocks.ROW} long, pid string, name string, height long, lon double")
    return df.withColumn("geometry", geo.st_point("lon", "lon"))


def test_block(spark, peaks):
    peaks.createOrReplaceTempView("peaks")
    b = Block("peaks", "pid", ["trim(regexp_replace(name, '[(].*', ''))"], ["name", "height"], geometry="geometry")
    plan = blocks.BlockPlan(spark, b)
    got = {r.identifier: r for r in plan.whole().collect()}
    assert got["p1"].data == '{"name":"Piz A (north)","height":800}' and got["p2"].data == '{"name":"Berg","height":null}'
    assert geo.parse_wkb(bytes(got["p1"].geometry)) == (geo.MULTIPOINT, [(1.0, 1.0), (2.0, 2.0)])
    assert geo.parse_wkb(bytes(got["p2"].geometry))[0] == geo.POINT
    assert {tuple(r) for r in plan.names().collect()} == {("p1", "Piz A"), ("p1", "Alt"), ("p2", "Berg")}
    with pytest.raises(ConfigError):
        blocks.BlockPlan(spark, Block("peaks", "t.pid", ["name"]))


def test_build_publish_and_search(spark, tmp_path):
    a = spark.createDataFrame([("1", "Paris,Lutetia"), ("2", "Berlin"), ("3", "Paris")], "pid string, name string")
    config = Config("places", [source("rows_a")], [Block("rows_a", "pid", ["explode(split(name, ','))"], ["name"])])
    tables = build.build(spark, config, {"rows_a": a})
    root = f"file://{tmp_path}"
    path = store.write(spark, root, "places", tables)
    assert store.installed(spark, root) == ["places"]
    g = store.Gazetteer(spark, path)
    assert len(g) == 3 and g.find(2).count() == 1 and [r.text for r in g.names_of(1).collect()] == ["Lutetia", "Paris"]
    index = Search.of(g)

    def ids(text, method, **more):
        return [r.identifier for r in search_one(spark, index, g.table("feature"), text, method, **more).collect()]

    assert ids("paris", "exact") == ids('  "Paris"  ', "exact") == ["1", "3"] and ids("Paris", "exact", limit=1) == ["1"]
    assert set(ids("Paris", "phrase", tiers=2)) == {"1", "3"} and set(ids("Paris Berlin", "partial", tiers=3)) == {"1", "2", "3"}
    assert ids("Barlin", "fuzzy") == ["2"] and ids("  ", "partial") == []
    with pytest.raises(ValueError):
        ids("x", "other")
    # a reader goes on while a new version is published, and a failed one changes nothing
    more = {"feature": tables["feature"], "name": tables["name"].where("text <> 'Lutetia'")}
    store.write(spark, root, "places", more)
    assert g.names_of(1).count() == 2 and store.Gazetteer(spark, path).names_of(1).count() == 1
    with pytest.raises(store.StoreError):
        store.write(spark, root, "places", {"feature": tables["feature"].limit(0), "name": tables["name"]})
    assert len(store.versions(spark, path)) == 2 and len(store.Gazetteer(spark, path)) == 3
    assert [r.v for r in g.find(1).select(g.data_value("name").alias("v")).collect()] == ["Paris,Lutetia"]
    assert store.uninstall(spark, root, "places") and store.installed(spark, root) == []


def test_blocks_may_not_share_identifiers(spark):
    a = spark.createDataFrame([("1", "A")], "pid string, name string")
    config = Config("g", [source("rows_a"), source("rows_b")], [Block("rows_a", "pid", ["name"]), Block("rows_b", "pid", ["name"])])
    with pytest.raises(build.BuildError):
        build.build(spark, config, {"rows_a": a, "rows_b": a})


def test_dense_ids_equal_row_numbers(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    rows = build.dense_ids(df, [F.col("k")], "id").collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.id)] == sorted(r.k for r in rows) and {r.id for r in rows} == set(range(1, 1001))
    assert Source(**source("s")).tabular


def test_spatial_joins_in_blocks(spark):
    """Places with the names of the areas that hold them, and of what an area's key leads to."""
    geo.register(spark)
    square = "POLYGON(({0} 0, {1} 0, {1} 10, {0} 10, {0} 0))"
    spark.sql("SELECT * FROM VALUES ('p1', 'Here', 'POINT(5 5)'), ('p2', 'There', 'LINESTRING(12 1, 18 9)'), ('p3', 'Nowhere', 'POINT(50 50)'), ('p4', 'Border', 'POINT(10 5)') AS t(UUID, NAME, w)").selectExpr("UUID", "NAME", "ST_GeomFromText(w) AS geometry").createOrReplaceTempView("sites_raw")
    spark.sql(f"SELECT * FROM VALUES ('West', 1, '{square.format(0, 10)}'), ('East', 2, '{square.format(10, 20)}') AS t(NAME, CANTON, w)").selectExpr("NAME", "CANTON", "ST_GeomFromText(w) AS geometry").createOrReplaceTempView("areas_raw")
    cantons = spark.createDataFrame([(1, "One"), (2, "Two")], "CANTON int, NAME string")
    joins = ["LEFT JOIN areas g ON ST_Within(ST_Centroid(geometry), g.geometry)", "LEFT JOIN cantons k ON g.CANTON = k.CANTON"]
    spatial = {"delimiter": None, "attributes": [*ATTR, {"name": "geometry", "type": "geometry"}]}
    sources = [{**source("sites"), **spatial}, {**source("areas"), **spatial}, source("cantons")]
    block = {"source": "sites", "identifier": "UUID", "geometry": "geometry", "names": ["NAME"], "data": ["NAME", "g.NAME AS area", "k.NAME AS canton"], "joins": joins}
    tables = build.build(spark, Config("swiss", sources, [block]), {"sites": spark.table("sites_raw"), "areas": spark.table("areas_raw"), "cantons": cantons})
    got = {r.identifier: r.data for r in tables["feature"].collect()}
    assert got["p1"] == '{"NAME":"Here","area":"West","canton":"One"}' and got["p2"] == '{"NAME":"There","area":"East","canton":"Two"}'
    assert got["p3"] == '{"NAME":"Nowhere","area":null,"canton":null}' and got["p4"] == '{"NAME":"Border","area":null,"canton":null}'
    assert tables["name"].count() == 4
    # the other way round, and a condition besides
    block["joins"] = ["JOIN areas AS g ON ST_Contains(g.geometry, src.geometry) AND g.CANTON > 1"]
    block["data"] = ["g.NAME AS area"]
    plan = blocks.BlockPlan(spark, Block(**block))
    assert [(r.identifier, r.data) for r in plan.features().collect()] == [("p2", '{"area":"East"}')]
    assert "CartesianProduct" not in plan.features()._jdf.queryExecution().toString() and "NestedLoop" not in plan.features()._jdf.queryExecution().toString()
    with pytest.raises(ConfigError):
        blocks.BlockPlan(spark, Block(**{**block, "joins": ["JOIN areas g ON ST_Within(geometry, src.geometry)"]})).features()


def test_unknown_columns_are_told_with_hints(spark, peaks):
    peaks.createOrReplaceTempView("peaks")
    spark.createDataFrame([("p1", "x")], "pid string, other string").createOrReplaceTempView("more")
    with pytest.raises(ConfigError, match="unknown column hieght; did you mean height"):
        blocks.BlockPlan(spark, Block("peaks", "pid", ["name"], ["hieght AS h"])).features()
    # a bare name that only a joined table has is not the source's own
    with pytest.raises(ConfigError, match="identifier reads the unknown column other"):
        blocks.BlockPlan(spark, Block("peaks", "other", ["name"], joins=["JOIN more m ON pid = m.pid"]))
    assert blocks.BlockPlan(spark, Block("peaks", "pid", ["other"], joins=["JOIN more m ON pid = m.pid"])).names().count() == 1


def test_phrases_with_common_tokens(spark):
    """A token that every name has is never looked up in a phrase that has a rarer one."""
    rows = [(i, i, f"saint place {i} saint place {i % 7}") for i in range(1, 200)]
    name = spark.createDataFrame(rows, "id long, feature_id long, text string")
    index = Search(name, build.postings(name), build.soundex_codes(name))
    q = spark.createDataFrame([(1, "saint place 3"), (2, "place 5 saint"), (3, "saint unknown"), (4, "place 4 saint place 4")], "query_id int, text string")

    def brute(words):
        hits = {}
        for i, _, text in rows:
            t = text.split()
            f = sum(t[k : k + len(words)] == words for k in range(len(t)))
            if f:
                hits[i] = f
        return hits

    got = {}
    for r in occurrences(q.select("query_id", F.lit(0).alias("phrase"), F.split("text", " ").alias("tokens")), index.posting, index.held, index.vocabulary).collect():
        got.setdefault(r.query_id, {})[r.name_id] = r.f
    assert got == {i: brute(t.split()) for i, t in ((1, "saint place 3"), (2, "place 5 saint"), (4, "place 4 saint place 4"))}
    whole = spark.createDataFrame([(1, "Saint place 9 saint place 2"), (2, "saint place 9")], "query_id int, text string")
    assert [(r.query_id, r.feature_id) for r in index.exact(whole).collect()] == [(1, 9)]


def _random_names(spark, n=1500):
    import random

    rnd = random.Random(7)
    words = ["saint", "new", "old", "rio", "monte"] + [f"place{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    draw = lambda: words[min(len(words) - 1, int(rnd.paretovariate(0.35)) - 1)]
    rows = [(i, i // 2 + 1, " ".join(draw() for _ in range(rnd.randrange(1, 6)))) for i in range(1, n)]
    rows += [(n + i, n, "saint saint") for i in range(3)]
    return rows, words, spark.createDataFrame(rows, "id long, feature_id long, text string")


def test_bounded_partial_search_equals_the_plain_one(spark):
    rows, words, name = _random_names(spark)
    index = Search(name, build.postings(name), build.soundex_codes(name))
    texts = ["saint", "saint new", "monte placeab", "saint saint rio", "new old rio monte", "unknown saint", "placeaa placeba placeca", "unknown", "saint-new old"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    split = q.select("query_id", F.posexplode(F.split("text", " ")).alias("phrase", "w")).select("query_id", "phrase", tokens(F.col("w")).alias("tokens"))
    plain = index._scored(split)
    for limit, tiers in ((10_000, 1), (5, 1), (40, 3)):
        want = sorted((r.query_id, r.feature_id, r.tier, r.position) for r in ranked(plain, limit, tiers).collect())
        got = sorted((r.query_id, r.feature_id, r.tier, r.position) for r in index.partial(q, limit, tiers).collect())
        assert got == want and got, (limit, tiers)


def test_common_words_are_not_read_whole(spark):
    """A word of nearly all names: a bounded number of its names is looked at, or none beside a rarer word."""
    rows = [(i, i, f"saint place{i % 50} of{i % 7} x{i % 3}") for i in range(1, 5000)] + [(5000, 5000, "saint"), (5001, 5001, "saint place7")]
    name = spark.createDataFrame(rows, "id long, feature_id long, text string")
    index = Search(name, build.postings(name), build.soundex_codes(name))
    q = spark.createDataFrame([(0, "saint"), (1, "saint"), (1, "place7")], "query_id int, token string")
    seen = {r["query_id"]: r["count"] for r in index.candidates(index.bounds(q, 10_000, 1)).groupBy("query_id").count().collect()}
    assert seen[0] == 1 and seen[1] <= 101
    ten = {r["query_id"]: r["count"] for r in index.candidates(index.bounds(q.where("query_id = 1"), 10, 5)).groupBy("query_id").count().collect()}
    assert ten[1] <= 101


def test_fuzzy_rings_equal_all_pairs_and_compare_few(spark):
    import random

    rnd = random.Random(3)
    letters = "aeiou"
    base = ["".join(c + rnd.choice(letters) * rnd.randrange(1, 3) for c in "rbrt") + rnd.choice(letters) * rnd.randrange(0, 9) for _ in range(400)]
    rows = [(i, i // 2, t) for i, t in enumerate(base)] + [(900, 900, "Robert"), (901, 901, "Rupert"), (902, 902, "...")]
    name = spark.createDataFrame(rows, "id long, feature_id long, text string")
    index = Search(name, build.postings(name), build.soundex_codes(name))
    q = spark.createDataFrame(list(enumerate(["Robert", "Rabarat", "rbrtaeiouaeiouaeiouaeiou", "zz", "roberta eiou"])), "query_id int, text string")
    pairs = q.withColumn("code", soundex(F.col("text"))).join(index.codes, "code")
    plain = pairs.select("query_id", "feature_id", edit_distance(F.col("text"), F.col("norm")).cast("double").alias("score"))
    for limit, tiers in ((10_000, 3), (4, 2)):
        want = sorted((r.query_id, r.feature_id, r.score, r.tier, r.position) for r in ranked(plain, limit, tiers).collect())
        got = sorted((r.query_id, r.feature_id, r.score, r.tier, r.position) for r in index.fuzzy(q, limit, tiers).collect())
        assert got == want and got
    one = q.where("query_id = 0").select("query_id", soundex(F.col("text")).alias("code"), normal_form(F.col("text")).alias("norm"))
    one = one.withColumn("len", F.length("norm")).withColumn("letters", letter_set(F.col("norm")))
    assert index.compared(one, 1).count() < 0.1 * index.compared(one, None).count()


def test_two_publishers_at_once_give_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    feature = spark.createDataFrame([(1, "a", "s", "{}", None)], "id long, identifier string, source string, data string, geometry binary")
    name = spark.createDataFrame([(1, 1, "Paris")], "id long, feature_id long, text string")
    root = f"file://{tmp_path}"
    with ThreadPoolExecutor(2) as pool:
        paths = list(pool.map(lambda _: store.write(spark, root, "g", {"feature": feature, "name": name}), range(2)))
    assert len(store.versions(spark, paths[0])) == 2 and len(set(store.versions(spark, paths[0]))) == 2
    assert len(store.Gazetteer(spark, paths[0])) == 1


def _stored(spark, root, **more):
    rows, _, name = _random_names(spark)
    feature = spark.createDataFrame([(i, f"f{i}", "s", "{}", None) for i in range(1, 1501)], "id long, identifier string, source string, data string, geometry binary")
    return name, store.Gazetteer(spark, store.write(spark, root, "g", {"feature": feature, "name": name}, **more))


def test_stored_buckets_with_split_tokens_give_the_same_results(spark, tmp_path):
    name, g = _stored(spark, f"file://{tmp_path}/it's", bucket_rows=100, salt_rows=20)
    plain, index = Search(name, build.postings(name), build.soundex_codes(name)), Search.of(g)
    assert g.metadata["buckets"] == "16"
    often = index.posting.where("token = 'saint'")
    assert often.select("salt").distinct().count() == index.vocabulary.where("token = 'saint'").first().salts > 5
    assert often.select(F.col("_metadata.file_name")).distinct().count() > 3
    assert index.posting.drop("salt").exceptAll(plain.posting.select(index.posting.drop("salt").columns)).count() == 0 and index.posting.count() == plain.posting.count()
    q = spark.createDataFrame(list(enumerate(["saint", "saint new", "monte placeab", "new old rio", "unknown saint", "unknown"])), "query_id int, text string")
    for method in ("exact", "phrase", "partial", "fuzzy"):
        want, got = (sorted(map(tuple, s.search(q, method, 50, 2).collect())) for s in (plain, index))
        assert got == want and got, method
        one = sorted((r.feature_id, r.position) for r in search_one(spark, index, g.table("feature"), "saint new", method, 50, 2).collect())
        assert one == sorted((r.feature_id, r.position) for r in plain.search(q.where("query_id = 1"), method, 50, 2).collect()), method
    assert store.uninstall(spark, f"file://{tmp_path}/it's", "g")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("gazetteer_", "draft_")) and not t.isTemporary]


def _plan(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _above_scans(node, above=()):
    """For each scan, its table and the operators between it and the join above."""
    here = () if "Join" in node.nodeName() else (node.nodeName(), *above)
    if node.children().isEmpty():
        yield (node.nodeName(), above)
    for i in range(node.children().size()):
        yield from _above_scans(node.children().apply(i), here)


def test_lookups_do_not_shuffle_the_store(spark, tmp_path):
    _, g = _stored(spark, f"file://{tmp_path}")
    index = Search.of(g)
    q = spark.createDataFrame([(1, 0, ["saint"]), (2, 0, ["saint", "new"])], "query_id int, phrase int, tokens array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scans = [(n, a) for n, a in _above_scans(_plan(occurrences(q, index.posting, index.held, index.vocabulary))) if "gazetteer_" in n]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {n.rsplit("_", 1)[-1] for n, _ in scans} == {"posting", "vocabulary", "tokens"}
    assert not [n for n, a in scans if any("Exchange" in x for x in a)]


def _rows_read(df):
    df.collect()
    def leaves(node):
        if node.children().isEmpty():
            yield node
        for i in range(node.children().size()):
            yield from leaves(node.children().apply(i))
    return sum(n.metrics().apply("numOutputRows").value() for n in leaves(_plan(df)))


def test_absent_keys_leave_row_groups_unread(spark, tmp_path):
    _, g = _stored(spark, f"file://{tmp_path}")
    # within the range of what is stored, so that statistics alone leave a row group to be read
    for table, key, absent in (("posting", "token", "placeaa0"), ("feature", "identifier", "f5000"), ("name_soundex", "code", "P299")):
        t = g.table(table)
        low, high = t.agg(F.min(key), F.max(key)).first()
        assert low < absent < high
        assert _rows_read(t.where(F.col(key) == absent)) == 0, table
        spark.conf.set("spark.sql.parquet.filterPushdown", "false")
        try:
            assert _rows_read(g.table(table).where(F.col(key) == absent)) > 0
        finally:
            spark.conf.set("spark.sql.parquet.filterPushdown", "true")
