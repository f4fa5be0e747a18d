import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.operators import build, project, resolve
from toposcope.operators.reranker import FEATURES, PairReranker, pair_features
from toposcope.operators.search import Search
from toposcope.operators.tagger import PerceptronRecognizer, Weights, gold_tags, one_epoch, tagged_spans

SPANS = "id string, text string, spans array<struct<start:int,end:int>>"
FIRST = ["Alt", "Bern", "Cal", "Dor", "Elm", "Fal", "Gol", "Har", "Ist", "Kar"]
LAST = ["burg", "dorf", "ville", "ton", "ham", "stad"]


def corpus(n, seed):
    """Sentences with names of places, which come after certain words; people have other ones."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text, spans = "", []
        for _ in range(rnd.randrange(1, 4)):
            name = rnd.choice(FIRST) + rnd.choice(LAST) + (" " + rnd.choice(["North", "Old"]) if rnd.random() < 0.3 else "")
            lead, tail = rnd.choice([("They went to ", " by train. "), ("The town of ", " lies there. "), ("He lives near ", ", we hear. ")])
            spans.append((len(text) + len(lead), len(text) + len(lead) + len(name)))
            text += lead + name + tail + rnd.choice(["Mister Smith said so. ", "Nobody asked Peter. ", ""])
        rows.append((str(i), text, spans))
    return rows


def f1(want, got):
    hit = len(want & got)
    return 2 * hit / (len(want) + len(got))


def test_trained_recognizer_on_held_out_documents(spark, tmp_path):
    train, test = corpus(300, 1), corpus(100, 2)
    learnt = PerceptronRecognizer(bits=14).fit(spark.createDataFrame([*train, ("x", None, []), ("y", "unknown", None)], SPANS), epochs=4, partitions=4)
    assert learnt.mistakes[-1] < learnt.mistakes[0]
    docs = spark.createDataFrame([(i, t) for i, t, _ in test] + [("null", None), ("empty", "")], "id string, text string")
    got = {r.id: r.spans for r in learnt(docs).collect()}
    assert got["null"] is None and got["empty"] == []
    want = {(i, a, b) for i, _, spans in test for a, b in spans}
    assert f1(want, {(i, s.start, s.end) for i, spans in got.items() for s in spans or ()}) > 0.95
    learnt.save(spark, f"file://{tmp_path}/m")
    again = PerceptronRecognizer.load(spark, f"file://{tmp_path}/m")
    assert {r.id: r.spans for r in again(docs).collect()} == got
    with pytest.raises(ValueError, match="no annotated"):
        PerceptronRecognizer().fit(spark.createDataFrame([], SPANS))
    with pytest.raises(ValueError, match="first"):
        PerceptronRecognizer()(docs)


def test_mixing_is_the_mean_of_the_parts(spark):
    rows = corpus(40, 3)
    df = spark.createDataFrame(rows, SPANS).repartition(2, "id").cache()
    parts = df.select("text", "spans").rdd.glom().collect()
    moved = [one_epoch(Weights(12), ((r.text, [(s.start, s.end) for s in r.spans]) for r in p)) for p in parts if p]
    learnt = PerceptronRecognizer(bits=12).fit(df, epochs=1)
    assert np.allclose(learnt.weights, np.mean([v for v, _ in moved], axis=0), atol=1e-4)
    assert learnt.mistakes == [sum(m for _, m in moved)]


def test_averaged_weights_equal_the_mean_over_steps():
    docs = [("to Altburg by", [(3, 10)]), ("Peter to Calton", [(9, 15)])]
    values, mistakes = one_epoch(Weights(8), iter(docs))
    from toposcope.operators import tagger as G

    rows, seen, before_all = np.zeros(((1 << 8) + 3, 3)), [], 0
    for text, spans in docs:
        words, places = G._tokens(text)
        before = 0
        for i, want in enumerate(gold_tags(places, spans)):
            at = [*G._features(words, i, 8), (1 << 8) + before]
            got = int(rows[at].sum(0).argmax())
            seen.append(rows.copy())  # the weights that this step was decided by
            if got != want:
                before_all += 1
                for f in at:
                    rows[f, want] += 1
                    rows[f, got] -= 1
            before = want
    assert before_all == mistakes and np.allclose(values, np.mean([*seen, rows], axis=0).ravel(), atol=1e-5)


def test_tags_and_spans():
    places = [(0, 3), (4, 8), (9, 12), (12, 13)]
    assert gold_tags(places, [(4, 12)]) == [0, 1, 2, 0] and tagged_spans(places, [0, 1, 2, 0]) == [(4, 12)]
    assert gold_tags(places, [(5, 8)]) == [0, 0, 0, 0] and tagged_spans(places, [2, 0, 1, 1]) == [(0, 3), (9, 12), (12, 13)]


@pytest.fixture(scope="module")
def world(spark):
    rows = [(i * 3 + k, f"f{i}-{k}", f"Place{i}", f"Place{i} ({kind}) in {land}, Earth") for i in range(30) for k, (kind, land) in enumerate((("city", "France"), ("village", "Texas"), ("lake", "Kenya")))]
    features = spark.createDataFrame([(a + 1, b, c, d) for a, b, c, d in rows], "feature_id long, identifier string, text string, description string").cache()
    name = features.select(F.col("feature_id").alias("id"), "feature_id", "text")
    return features, Search(name, build.postings(name), build.soundex_codes(name))


def test_reranker_weights_solve_the_normal_equations(spark, world):
    rnd = random.Random(5)
    pairs = [(f"a story of {rnd.choice(['France', 'Texas', 'Kenya'])} and a {rnd.choice(['city', 'lake'])}", f"P ({kind}) in {land}, Earth", int(rnd.random() < 0.3)) for _ in range(200) for kind, land in [(rnd.choice(["city", "lake"]), rnd.choice(["France", "Kenya"]))]]
    df = spark.createDataFrame(pairs, "context string, description string, label int")
    x = np.array([r.x for r in df.select(F.array(*pair_features(F.col("context"), F.col("description"))).alias("x")).collect()])
    y = np.array([p[2] for p in pairs], float)
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    want = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    learnt = PairReranker().fit(df)
    assert np.allclose(learnt.weights, want, atol=1e-8) and PairReranker.from_json(learnt.to_json()).weights == learnt.weights and len(FEATURES) == x.shape[1]
    with pytest.raises(ValueError, match="both labels"):
        PairReranker().fit(df.where("label = 0"))


def test_training_from_a_project_and_resolving_with_what_was_learnt(spark, tmp_path, world):
    features, index = world
    lands = ["France", "Texas", "Kenya"]
    p = project.Project(spark, f"file://{tmp_path}/p", "demo")
    docs = [(str(i), f"Place{i % 30} was seen in {lands[i % 3]} today") for i in range(60)]
    p.create_documents(spark.createDataFrame(docs, "id string, text string"))
    spans = [(i, 0, t.index(" "), f"f{int(i) % 30}-{int(i) % 3}") for i, t in docs]
    notes = spark.createDataFrame(spans, "document_id string, start int, end int, loc_id string")
    p.load_annotations(notes, "gold")
    assert p.annotated("gold").count() == 60 and p.annotated_mentions("gold").count() == 60
    tagger = p.train_recognizer(PerceptronRecognizer(bits=12), "gold", epochs=3)
    assert {(r.id, s.start, s.end) for r in tagger(p.documents()).collect() for s in r.spans} == {s[:3] for s in spans}
    reranker = p.train_resolver(PairReranker(), "gold", index, features.select("feature_id", "identifier", "description"))
    mentions = p.annotated_mentions("gold")
    found = resolve.tiered(mentions, index, features, f"file://{tmp_path}/t", least=0.0, rerank=reranker, k=20, passes=[(1, "exact")])
    got = dict(map(tuple, found.select("id", "identifier").collect()))
    right = sum(got.get(r.id) == r.gold for r in mentions.collect()) / 60
    assert right == 1.0
    with pytest.raises(TypeError):
        p.train_recognizer(object(), "gold")
