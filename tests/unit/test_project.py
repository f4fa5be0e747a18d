import pytest
from pyspark.sql import functions as F

from toposcope.operators import build, facade, project, recognize, resolve
from toposcope.operators.search import Search
from toposcope.sources import sinks
from toposcope.streaming.incremental import recognize_stream

SPANS = "array<struct<start:int,end:int>>"


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, "par-fr", "Paris", "Paris (city) in France", "2000000"), (2, "par-tx", "Paris", "Paris (town) in Texas, USA", "25000"), (3, "ber", "Berlin", "Berlin (city) in Germany", "3500000")]
    df = spark.createDataFrame(rows, "feature_id long, identifier string, text string, description string, population string").cache()
    name = df.select(F.col("feature_id").alias("id"), "feature_id", "text")
    return df, Search(name, build.postings(name), build.soundex_codes(name))


def test_recognize_resolve_and_views(spark, tmp_path, places):
    features, index = places
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    with pytest.raises(TypeError):
        p.create_documents("text")
    p.create_documents(spark.createDataFrame([("a", "He saw Paris, Texas.\r\nBerlin too."), ("b", "nothing here"), ("c", "unavailable")], "id string, text string"))
    words = spark.createDataFrame([("Paris",), ("berlin",)], "word string")
    by_word = recognize.dictionary(words)

    def predict(docs):
        found = by_word(docs)
        return found.withColumn("spans", F.when(F.col("id") != "c", F.col("spans")))

    p.recognize("dict", predict)
    p.recognize("dict", predict)  # only c is still open, and it stays unavailable
    assert {(r.document_id, r.start, r.end, r.text) for r in p.table("reference").collect()} == {("a", 7, 12, "Paris"), ("a", 21, 27, "Berlin")}
    assert {r.document_id for r in p.table("recognition").collect()} == {"a", "b"}
    assert p.view().where("feature_identifier is null").count() == 2

    def link(refs):
        mentions = refs.select("id", F.col("text").alias("name"), F.col("document_text").alias("context"))
        return resolve.tiered(mentions, index, features, f"file://{tmp_path}/r", least=0.02)

    p.resolve("tier", link, features, "g")
    got = {r.text: r.feature_identifier for r in p.view().collect()}
    assert got == {"Paris": "par-tx", "Berlin": "ber"}
    p.load_annotations(spark.createDataFrame([("b", 0, 7, "ber"), ("b", 8, 12, "")], "document_id string, start int, end int, loc_id string"), "gold")
    assert {(r.text, r.feature_identifier) for r in p.view("gold").collect()} == {("nothing", "ber"), ("here", None)}
    assert [r.id for r in project.in_order(p.documents(), ["c", "a"]).collect()] == ["c", "a"]
    with pytest.raises(KeyError):
        project.in_order(p.documents(), ["zz"])
    p.update_documents(spark.createDataFrame([("a", "new text"), ("zz", "unknown")], "id string, text string"))
    assert {(r.id, r.text) for r in p.documents().collect()} == {("a", "new text"), ("b", "nothing here"), ("c", "unavailable")}
    assert p.table("reference").where("document_id = 'a'").count() == 0 and p.table("reference").where("document_id = 'b'").count() == 2
    p.delete_documents(spark.createDataFrame([("c",)], "id string"))
    assert {r.id for r in p.documents().collect()} == {"a", "b"}
    other = project.Project(spark, f"file://{tmp_path}/p", "other")
    other.create_documents(spark.createDataFrame([("x", "kept")], "id string, text string"))
    p.delete()
    assert [r.id for r in other.documents().collect()] == ["x"]
    assert p.documents().count() == 0 and p.table("reference").count() == 0


def test_a_repeated_service_call_adds_nothing_twice(spark, tmp_path):
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame([("a", "Paris")], "id string, text string"))
    find = lambda docs: docs.select("id", F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"))).alias("spans"))
    p.recognize("m", find)
    p.recognize("m", find)
    assert p.table("reference").count() == 1 and p.table("recognition").count() == 1


def test_parse_in_one_call(spark, places):
    features, index = places
    known = recognize.dictionary(spark.createDataFrame([("Paris",), ("berlin",)], "word string"))
    links = lambda refs: refs.where("text = 'Berlin'").select("id", F.lit("ber").alias("identifier"))
    got = {r.id: r for r in facade.parse(spark, ["Paris,\r\nBerlin", "none", ""], known, links, features, ("population",)).collect()}
    assert [(t.start, t.text, t.identifier, t.population) for t in got["0"].toponyms] == [(0, "Paris", None, None), (7, "Berlin", "ber", "3500000")]
    assert got["0"].text == "Paris,\nBerlin" and got["1"].toponyms == [] and got["2"].toponyms == []
    absent = facade.parse(spark, "x", lambda docs: docs.select("id", F.lit(None).cast(SPANS).alias("spans")), links, features).first()
    assert absent.toponyms is None
    with pytest.raises(TypeError):
        facade.parse(spark, [1], known, links, features)


def test_fit_goes_to_modules_that_can_be_trained():
    class Trained:
        def fit(self, rows, epochs=1):
            return rows, epochs

    assert facade.fit(Trained(), "rows", epochs=3) == ("rows", 3)
    with pytest.raises(TypeError, match="cannot be trained"):
        facade.fit(object())


def test_run_checkpoints(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    assert sinks.resume(spark, path).count() == 0
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    sinks.checkpoint(docs.where("id = 'a'"), path, "recognize", {"model": 1})
    done = sinks.resume(spark, path, {"model": 1})
    assert [r.id for r in sinks.remaining(docs, done, "recognize").collect()] == ["b"] and sinks.remaining(docs, done, "resolve").count() == 2
    with pytest.raises(ValueError, match="model"):
        sinks.resume(spark, path, {"model": 2})


def test_prior_threshold_fallback_and_rerank(spark, tmp_path, places):
    features, index = places
    one = spark.createDataFrame([(1, "Paris", "Paris"), (2, "Berlins", "Berlin"), (3, "Nowhere", "x")], "id int, name string, context string")
    path = f"file://{tmp_path}/t"
    plain = {r.id: r.identifier for r in resolve.tiered(one, index, features, path, least=0.0, passes=resolve.PASSES[:1], inflection=True, weight=5.0).collect()}
    assert plain == {1: "par-fr", 2: "ber"}
    none = resolve.tiered(one, index, features, path + "2", least=0.99, passes=resolve.PASSES[:2])
    assert none.count() == 0
    backwards = lambda rows: rows.withColumn("score", -F.col("similarity"))
    got = {r.id: r.identifier for r in resolve.tiered(one, index, features, path + "3", least=0.0, passes=resolve.PASSES[:1], rerank=backwards).collect()}
    forwards = {r.id: r.identifier for r in resolve.tiered(one, index, features, path + "4", least=0.0, passes=resolve.PASSES[:1]).collect()}
    assert {got[1], forwards[1]} == {"par-fr", "par-tx"}
    pairs = resolve.training_pairs(one.withColumn("gold", F.lit("par-tx")), index, features)
    assert {(r.description[:12], r.label) for r in pairs.collect()} == {("Paris (city)", 0), ("Paris (town)", 1)}


def test_manual_modules_and_checks(spark):
    known = spark.createDataFrame([("t", [(0, 1)], 1), ("t", [(1, 2)], 2)], f"text string, spans {SPANS}, pos int")
    docs = spark.createDataFrame([("a", "t"), ("b", "u")], "id string, text string")
    assert {r.id: r.spans for r in recognize.manual(known)(docs).collect()} == {"a": [(0, 1)], "b": None}
    scored = spark.createDataFrame([("ab cd", [(0, 2, 0.9, "ab"), (3, 5, 0.5, "cd"), (3, 9, 0.9, "cd"), (0, 2, 0.8, "xx")])], "text string, s array<struct<start:int,end:int,score:double,surface:string>>")
    assert scored.select(recognize.checked(F.col("s"), F.col("text"), 0.5).alias("x")).first().x == [(0, 2)]
    model = recognize.model(lambda: lambda texts: [[(0, 1)] if t == "t" else None for t in texts])
    assert {r.id: r.spans for r in model(docs).collect()} == {"a": [(0, 1)], "b": None}
    refs = spark.createDataFrame([("r", "t", 0, 1)], "id string, document_text string, start int, end int")
    assert resolve.manual(spark.createDataFrame([("t", 0, 1, "x")], "document_text string, start int, end int, identifier string"))(refs).first().identifier == "x"


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "to Paris"), ("b", "none")], "id string, text string").write.parquet(f"{tmp_path}/in")
    p = project.Project(spark, f"file://{tmp_path}/p", "s")
    words = spark.createDataFrame([("paris",)], "word string")
    stream = spark.readStream.schema("id string, text string").parquet(f"{tmp_path}/in")
    q = recognize_stream(stream, p, "dict", recognize.dictionary(words), f"file://{tmp_path}/c")
    q.awaitTermination(120)
    assert q.exception() is None and p.documents().count() == 2 and [r.text for r in p.table("reference").collect()] == ["Paris"]


def test_model_recognizers_on_long_texts(spark):
    def load():
        import re

        def predict(texts):
            assert all(len(t) <= 60 for t in texts)
            return [None if "broken" in t else [m.span() for m in re.finditer("Paris", t)] for t in texts]

        return predict

    text = "x" * 37 + " Paris " + "y" * 90 + " Paris"
    docs = spark.createDataFrame([("a", text), ("b", "Paris"), ("c", None), ("d", ""), ("e", text + " broken")], "id string, text string")
    got = {r.id: r.spans for r in recognize.model(load, window=60, overlap=20)(docs).collect()}
    assert [(s.start, s.end) for s in got["a"]] == [(38, 43), (135, 140)] and text[135:140] == "Paris"
    assert len(got["b"]) == 1 and got["c"] is None and got["d"] == [] and got["e"] is None
    short = {r.id: r.spans for r in recognize.model(load, most_chars=60)(docs).collect()}
    assert short["a"] is None and len(short["b"]) == 1
    for n in (1, 59, 60, 61, 100, 140):
        parts = recognize.pieces("z" * n, 60, 20)
        assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == n and all(b[0] - a[0] == 40 for a, b in zip(parts, parts[1:], strict=False))
    with pytest.raises(ValueError):
        recognize.model(load, window=10, overlap=10)


def _brute_spans(docs):
    return docs.withColumn("spans", F.expr("array(named_struct('start', 0, 'end', least(3, length(text))))"))


def test_writers_and_readers_at_the_same_time_lose_nothing(spark, tmp_path):
    """Four writers append, tag and delete while a reader looks: every version is whole, and the end is as expected."""
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/p"
    project.Project(spark, root, "demo").create_documents(spark.createDataFrame([("gone", "old text")], "id string, text string"))
    odd = []

    def write(k):
        p = project.Project(spark, root, "demo")
        for j in range(3):
            p.create_documents(spark.createDataFrame([(f"{k}-{j}", f"text {k} {j}")], "id string, text string"))
            p.tag("t", recognizer_id=f"r{k}-{j}")
        p.delete_documents(spark.createDataFrame([("gone",)], "id string"))

    def read(_):
        for _ in range(12):
            s = project.Project(spark, root, "demo").tables.at()
            n, versions = s.table("document").count(), [r.version for r in s.table("context").collect()]
            if not n or sorted(versions) != list(range(1, len(versions) + 1)):
                odd.append((s.number, n, versions))

    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda f: f[0](f[1]), [(write, 0), (write, 1), (write, 2), (write, 3), (read, 0)]))
    p = project.Project(spark, root, "demo")
    assert not odd
    assert {r.id for r in p.documents().collect()} == {f"{k}-{j}" for k in range(4) for j in range(3)}
    assert sorted(r.version for r in p.table("context").collect()) == list(range(1, 13))


def test_two_runs_of_a_module_at_once_give_one_result(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame([(str(i), f"Paris {i}") for i in range(20)], "id string, text string"))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: project.Project(spark, f"file://{tmp_path}/p", "demo").recognize("m", _brute_spans), range(3)))
    assert p.table("reference").count() == 20 == p.table("recognition").count() and p.table("recognizer").count() == 1


def test_an_interrupted_commit_shows_nothing(spark, tmp_path, monkeypatch):
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame([("a", "Paris")], "id string, text string"))
    monkeypatch.setattr(p.tables, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        p.tables.append({"document": p.table("document")})
    monkeypatch.undo()
    assert p.documents().count() == 1
    p.recognize("m", _brute_spans)
    assert p.table("reference").count() == 1 and p.table("recognition").count() == 1
    # a reader holds on to its version; compaction and clearing change nothing that counts
    held = p.tables.at()
    p.create_documents(spark.createDataFrame([("b", "Berlin")], "id string, text string"))
    p.tables.compact("document")
    assert held.table("document").count() == 1 and p.documents().count() == 2 and len(p.tables.at().folders["document"]) == 1
    p.tables.forget(1)
    assert p.documents().count() == 2 and p.table("reference").count() == 1


def test_references_and_referents_by_hand_and_updates(spark, tmp_path):
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame([("a", "Paris and Rome"), ("b", "Rome")], "id string, text string"))
    spans = spark.createDataFrame([("a", 0, 5), ("a", 10, 14), ("b", 0, 4)], "document_id string, start int, end int")
    p.create_references(spans, "gold")
    links = spark.createDataFrame([("a", 0, 5, "1"), ("b", 0, 4, "2")], "document_id string, start int, end int, identifier string")
    p.create_referents(links, "places", "gold")
    got = {(r.document_id, r.text): r.feature_identifier for r in p.view("gold").collect()}
    assert got == {("a", "Paris"): "1", ("a", "Rome"): None, ("b", "Rome"): "2"}
    with pytest.raises(ValueError, match="fit no document"):
        p.create_references(spark.createDataFrame([("a", 3, 99)], "document_id string, start int, end int"), "bad")
    with pytest.raises(ValueError, match="no reference"):
        p.create_referents(spark.createDataFrame([("a", 1, 2, "1")], links.schema), "places", "gold")
    ref = p.table("reference").where("text = 'Paris'").first()
    p.update_references(spark.createDataFrame([(ref.id, 6, 9)], "id string, start int, end int"))
    got = {(r.document_id, r.text): r.feature_identifier for r in p.view("gold").collect()}
    assert got == {("a", "and"): None, ("a", "Rome"): None, ("b", "Rome"): "2"}
    # the same text changes nothing, another one takes what was found along
    p.update_documents(spark.createDataFrame([("a", "Paris and Rome"), ("b", "Roma"), ("unknown", "x")], "id string, text string"))
    assert {(r.id, r.text) for r in p.documents().collect()} == {("a", "Paris and Rome"), ("b", "Roma")}
    assert {r.document_id for r in p.view("gold").collect()} == {"a"}


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_are_sent_once_for_all_annotations(spark, tmp_path):
    """What recognition and resolution shuffle is about one copy of the texts."""
    import random

    deal, off = random.Random(3), ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    rows = [(f"d{i}", "".join(deal.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=50_000))) for i in range(40)]
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame(rows, "id string, text string"))
    marks = spark.createDataFrame([(d, at, at + 3, "L1" if at else "") for d, _ in rows[1:] for at in (0, 10)], "document_id string, start int, end int, loc_id string")
    before = _shuffled(spark)
    try:
        for name in off:
            spark.conf.set(name, "-1")
        p.load_annotations(marks, "gold")
        got = {(r.document_id, r.start, r.text, r.feature_identifier) for r in p.view("gold").collect()}
    finally:
        for name in off:
            spark.conf.unset(name)
    assert got == {(d, at, t[at : at + 3], "L1" if at else None) for d, t in rows[1:] for at in (0, 10)}
    assert p.table("recognition").count() == len(rows)
    assert _shuffled(spark) - before < 1.5 * sum(len(t) for _, t in rows)


def test_documents_that_change_during_recognition_keep_nothing_old(spark, tmp_path):
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    p.create_documents(spark.createDataFrame([("a", "old text"), ("b", "same"), ("c", "gone"), ("n", None)], "id string, text string"))

    def predict(docs):
        p.update_documents(spark.createDataFrame([("a", "new text"), ("b", "same")], "id string, text string"))
        p.delete_documents(spark.createDataFrame([("c",)], "id string"))
        p.create_documents(spark.createDataFrame([("e", "later")], "id string, text string"))
        return docs.select("id", F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 0, 'end', 3))").alias("spans"))

    p.recognize("m", predict)
    assert [(r.document_id, r.text) for r in p.table("reference").orderBy("document_id").collect()] == [("b", "sam"), ("n", None)]
    assert sorted(r.document_id for r in p.table("recognition").collect()) == ["b", "n"]
    p.recognize("m", _brute_spans)
    got = {r.document_id: r.text for r in p.table("reference").where("text is not null").collect()}
    assert got == {"a": "new", "b": "sam", "e": "lat"} and p.table("recognition").count() == 4
