import pytest
from pyspark.sql import functions as F

from toposcope.operators import annotate, evaluate

ANNOTATION = "document_id string, start int, end int, identifier string, latitude double, longitude double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], ANNOTATION)


@pytest.mark.parametrize(("gold", "predicted", "want"), [([], [("d", 0, 1)], (0, 1, 0)), ([("d", 0, 1)], [], (1, 0, 0)), ([("d", 0, 1)], [("d", 0, 1), ("d", 0, 1)], (1, 1, 1)), ([("d", 0, 1)], [("e", 0, 1)], (0, 0, 0)), ([], [], (1, 1, 1))])
def test_prf(spark, gold, predicted, want):
    r = evaluate.with_prf(evaluate.span_counts(frame(spark, gold), frame(spark, predicted))).first()
    assert (r.precision, r.recall, r.f1) == want


def test_distances_conflicts_and_accuracy(spark):
    gold = frame(spark, [("d", 0, 1, "x", 0.0, 0.0), ("d", 2, 3, "y", 10.0, 0.0)])
    predicted = frame(spark, [("d", 0, 1, "x", 0.0, 1.0)])
    errors = evaluate.distance_errors(gold, predicted)
    assert sorted(round(r.km) for r in errors.collect()) == [111, 20039]
    m = evaluate.distance_metrics(errors).first()
    assert m.accuracy == 0.5 and abs(m.median_km - m.mean_km) < 1e-9
    assert evaluate.resolution_accuracy(gold, predicted).first().accuracy == 0.5
    assert evaluate.gold_conflicts(gold).count() == 0 and evaluate.gold_conflicts(gold.union(frame(spark, [("d", 0, 1, "z")]))).count() == 1
    assert evaluate.check_annotations(frame(spark, [("d", 1, 1), ("d", 0, 1, None, 91.0, 0.0), ("d", 0, 1, None, 1.0), ("d", 0, 1)])).count() == 3


def test_bootstrap(spark):
    counts = spark.createDataFrame([(f"d{i}", 3, i % 2, 1, i % 3) for i in range(200)], "document_id string, tp long, fp long, fn long, s int")
    draws = evaluate.bootstrap(counts, 100, seed=2)
    f1 = 2 * 600 / (2 * 600 + 100 + 200)
    low, high = evaluate.interval(draws).first()
    assert draws.count() == 100 and low < f1 < high and high - low < 0.05
    assert draws.collect() == evaluate.bootstrap(counts, 100, seed=2).collect()
    assert evaluate.bootstrap(counts, 10, stratum="s").count() == 10
    # a draw has as many documents as there are, in each stratum
    assert {r.tp for r in draws.collect()} == {600}
    lone = spark.createDataFrame([(f"d{i}", 1, 0, i % 2, i % 2) for i in range(50)], "document_id string, tp long, fp long, fn long, s int")
    assert {r.fn for r in evaluate.bootstrap(lone, 20, stratum="s").collect()} == {25} and len({r.fn for r in evaluate.bootstrap(lone, 20).collect()}) > 3
    # moments of resampling with replacement
    fn = [r.fn for r in evaluate.bootstrap(lone, 600, seed=5).collect()]
    assert abs(sum(fn) / 600 - 25) < 0.6 and abs(sum((x - 25) ** 2 for x in fn) / 600 - 12.5) < 2.5
    both = counts.withColumn("p", F.lit("a")).unionByName(counts.withColumn("tp", F.col("tp") + 1).withColumn("p", F.lit("b")))
    paired = evaluate.bootstrap(both, 50, pipeline="p")
    assert paired.count() == 100 and evaluate.paired_difference(paired).where("difference < 0").count() == 50
    assert paired.groupBy("draw").agg(F.max("fp") - F.min("fp")).where("`(max(fp) - min(fp))` <> 0").count() == 0
    with pytest.raises(ValueError, match="share"):
        evaluate.bootstrap(both.where("p = 'a' or document_id <> 'd1'"), 5, pipeline="p")
    both = draws.withColumn("pipeline", F.lit("a")).union(evaluate.bootstrap(counts.withColumn("tp", F.col("tp") + 1), 100, seed=2).withColumn("pipeline", F.lit("b")))
    assert evaluate.paired_difference(both).where("difference < 0").count() == 100


def test_bootstrap_over_blocks_of_kinds(spark):
    """Blocks keep the number of documents, the pairing and the moments; strata may be null or empty."""
    counts = spark.createDataFrame([(f"d{i}", 1, i, i % 2, [None, "", "x"][i % 3]) for i in range(60)], "document_id string, tp long, fp long, fn long, s string")
    draws = evaluate.bootstrap(counts, 600, seed=4, block_kinds=7)
    got = draws.collect()
    assert {r.draw for r in got} == set(range(600)) and len(got) == 600 and {r.tp for r in got} == {60}
    fp = [r.fp for r in got]
    mean, variance = sum(range(60)), 60 * (60**2 - 1) / 12
    assert abs(sum(fp) / 600 - mean) < 0.25 * variance**0.5 and 0.8 < sum((x - mean) ** 2 for x in fp) / 600 / variance < 1.2
    assert {r.tp for r in evaluate.bootstrap(counts, 70, stratum="s", block_kinds=7).collect()} == {60}
    both = counts.withColumn("p", F.lit("a")).unionByName(counts.withColumn("p", F.lit("b")))
    paired = evaluate.bootstrap(both, 20, pipeline="p", block_kinds=7)
    assert paired.count() == 40 and paired.select("draw", "fp").distinct().count() == 20
    assert evaluate.bootstrap(counts.limit(0), 5).count() == 0


def test_protocol(spark):
    row = dict(gold=10, resolved=7, abstained=2, invalid=1, exact_eligible=10, exact_correct=5, coordinate_eligible=8, within_1_km=2, within_10_km=4, within_50_km=6, candidate_eligible=0, candidate_found=0)
    df = spark.createDataFrame([row])
    m = evaluate.protocol_metrics(df).first()
    assert (m.exact_accuracy, m.accuracy_50_km, m.coverage, m.candidate_recall) == (0.5, 0.75, 0.7, 0.0)
    assert evaluate.broken_counts(df).count() == 0 and evaluate.broken_counts(df.withColumn("gold", F.lit(9))).count() == 1
    bad = evaluate.with_invalid(spark.createDataFrame([(1, 0, 0, 1)], "tp long, fp long, fn long, invalid long")).first()
    assert bad.precision == 0.5


def test_annotator(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    t = spark.createDataFrame([("a", 1, 0, 5, "P", ""), ("a", 2, 4, 6, "Q", None), ("a", 3, 6, 9, "P", "x")], "document_id string, id int, start int, end int, text string, loc_id string")
    assert [(r.id, r.other_id) for r in annotate.overlapping(t).collect()] == [(1, 2)]
    assert {r.document_id: (r.total, r.annotated, round(r.percent)) for r in annotate.progress(docs, t).collect()} == {"a": (3, 2, 67), "b": (0, 0, 0)}
    done = annotate.propagate(t, spark.createDataFrame([("a", "P", "y")], "document_id string, text string, loc_id string"))
    assert {r.id: r.loc_id for r in done.collect()} == {1: "y", 2: None, 3: "x"}
    s = spark.createDataFrame([("s", "a", 3), ("s", "b", 7)], "session_id string, id string, doc_index int")
    assert {r.id: r.doc_index for r in annotate.reindex(s).collect()} == {"a": 0, "b": 1} and annotate.next_index(s).first().next == 8
    found = spark.createDataFrame([("m", "f1", 1)], "mention_id string, identifier string, position int")
    extra = spark.createDataFrame([("m", "f1"), ("m", "f2")], "mention_id string, identifier string")
    assert {r.identifier for r in annotate.candidate_list(found, extra).collect()} == {"f1", "f2"}
    sessions = spark.createDataFrame([("s", "g")], "id string, gazetteer string")
    own = spark.createDataFrame([("s", "a", 0, "f.txt", "P")], "session_id string, id string, doc_index int, filename string, text string")
    assert '"loc_id":"x"' in annotate.export_session(sessions, own, t).first().json


def test_languages(spark):
    rows = [("en", "d1", 0, 1), ("en", "d1", 2, 3), ("de", "d2", 0, 1)]
    gold = spark.createDataFrame(rows, "language string, document_id string, start int, end int")
    counts, missing = evaluate.score_languages(gold, gold.limit(0).unionByName(gold.where("start = 0")), ["de", "en", "fr", "fr", "it"])
    assert {r.language: (r.tp, r.fn) for r in counts.collect()} == {"en": (1, 1), "de": (1, 0)} and missing == ["fr", "it"]


def test_regression_gate_is_a_median_of_medians(spark):
    base = spark.createDataFrame([("q", r, s) for r, s in ((1, 1.0), (1, 1.0), (1, 9.0), (2, 2.0), (3, 3.0))], "benchmark string, run int, seconds double")
    got = evaluate.regressions(base, base.withColumn("seconds", F.col("seconds") * 1.3)).first()
    assert got.base == 2.0 and got.failed


def test_matching_is_dealt_out_by_rows_and_keeps_null_keys_apart(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MATCHED_AT_ONCE", 50)
    gold = spark.range(1000).selectExpr("id as document_id", "cast(id % 7 as int) as start", "9 as end")
    odd = spark.createDataFrame([(None, 1, 2)], "document_id long, start int, end int")
    both = evaluate.matched(gold.unionByName(odd), gold.where("document_id < 400").unionByName(gold).unionByName(odd), evaluate.SPAN)
    assert both.rdd.getNumPartitions() >= 2402 // 50
    row = evaluate.span_counts(gold.unionByName(odd), gold.where("document_id < 400").unionByName(odd)).first()
    assert (row.tp, row.fp, row.fn) == (400, 1, 601)
