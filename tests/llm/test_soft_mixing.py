import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.llm import soft_mixing as M


def totals(rows):
    a = np.array([np.array(r.posteriors) * r.n_tokens for r in rows])
    return a, np.array([r.rate for r in rows])


def test_rates_meet_the_default_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("rate", F.lit("own"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = M.mix(docs, labels).collect()
    assert len(rows) == docs.count()
    a, rate = totals(rows)
    assert (rate >= 0).all() and np.allclose([sum(r.posteriors) for r in rows], 1)
    names = sorted({r.domain for r in M.domain_of(labels).collect()})
    want = np.array([M.TARGETS.get(d, 0) for d in names]) * sum(r.n_tokens for r in rows)
    miss = np.abs(rate @ a - want).sum() / want.sum()
    assert miss <= 0.01 and np.allclose([r.miss for r in rows], miss, atol=1e-6)
    assert all(abs(x.copies - x.rate) < 1 for x in rows)


def test_classifier_on_unseen_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    report = M.fit_domains(docs, labels).report
    print(report)
    assert report["accuracy"] > report["constant_accuracy"] + 0.15
    assert report["log_loss"] < report["constant_log_loss"] / 3


@pytest.mark.parametrize("target", [(300.0, 100.0), (20.0, 400.0), (0.0, 100.0)])
def test_rates_against_plain_projected_gradient(spark, tmp_path, target):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.4, 0.95, 60)
    n = rng.integers(1, 12, 60)
    slim = spark.createDataFrame([(int(k), [float(x), float(1 - x)]) for k, x in zip(n, p, strict=True)] + [(0, [0.5, 0.5])], "n_tokens long, posteriors array<double>")
    want = np.array(target)
    steps, d, miss = M.fit_rates(slim, want, f"file://{tmp_path}/r")
    rows = slim.withColumn("rate", M._rate(steps, d)).collect()
    a, rate = totals(rows)
    r, top = np.ones(len(a)), np.linalg.norm(a.T @ a, 2)
    for _ in range(20_000):
        r = np.maximum(0, r - a @ (r @ a - want) / top)
    assert (rate >= 0).all()
    assert np.linalg.norm(rate @ a - want) <= 1.05 * np.linalg.norm(r @ a - want) + 0.002 * want.sum()
    assert miss == pytest.approx(np.abs(rate @ a - want).sum() / want.sum(), abs=1e-9)


def test_bound_of_targets_that_cannot_be_met():
    a, target = np.array([[0.9, 0.1], [0.6, 0.4]]), np.array([0.0, 1.0])
    best = min(np.linalg.norm(x * a[0] + y * a[1] - target) for x in np.linspace(0, 2, 201) for y in np.linspace(0, 2, 201))
    assert best - 1e-3 <= max(M.nearest(np.array(g), float((a @ np.array(g)).min()), target) for g in ([0.46, -0.69], [0.2, -0.3], [0.3, -0.1])) <= best + 1e-9
    assert M.nearest(np.array([-1.0, 1.0]), -0.8, target) == 0.0


def corpus(spark):
    good, bad = "fine words of a good story", "BAD bad words, poor poor"
    rows = [(i, f"{good} {i}" if i % 3 else f"{bad} {i}", "mine") for i in range(150)]
    rows += [(0, f"{bad} 0", "mine"), (200, None, "x"), (201, "", "x"), (None, good, "x"), (202, "good " * 30_000, "x")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)] + [(0, 0, 0), (5, None, 0), (None, 1, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_word_weights_and_posteriors_equal_brute_force(spark, tmp_path):
    docs, labels = corpus(spark)
    model = M.fit_domains(docs, labels, path=f"file://{tmp_path}/m")
    assert model.names == ["q0t0", "q1t0"] and model.report["texts"] == 120 and model.report["accuracy"] == 1
    sample = M._tokens(spark.read.parquet(f"file://{tmp_path}/m/sample")).collect()
    y = np.array([model.names.index(r.domain) for r in sample])
    seen, n = np.zeros((2, M.BUCKETS)), np.bincount(y)
    for r, c in zip(sample, y, strict=True):
        seen[c, r["__at"]] += 1
    for c in range(2):
        p = (seen[1 - c] + 0.5) / (n[1 - c] + 1)
        q = (seen[c] + M.SHRINK * p) / (n[c] + M.SHRINK)
        error = np.sqrt(n[c] * p * (1 - p) * (1 + n[c] / (n[1 - c] + 1)) + 0.5)
        told = np.where(np.abs(seen[c] - n[c] * p) > M.SURE * error, np.log(q / p), 0)
        told[seen.sum(axis=0) == 0] = 0
        assert np.allclose(told, [model.weights.get(b, [0, 0])[c] for b in range(M.BUCKETS)])
    tokens = M._tokens(docs).collect()
    got = {r.doc_id: r for r in M.with_posteriors(docs, model).collect()}
    for r in tokens:
        own, text = r["__words"], r.text or ""
        assert own == text.split()
        x = []
        for c in range(2):
            hits = [model.weights[b][c] for b in r["__at"] if b in model.weights]
            x += [min(20.0, max(-20.0, sum(hits))), max([0.0, *hits])]
        per = max(1, len(own))
        x += [np.log1p(len(own)), len(r["__at"]) / per, len(text) / per, sum("A" <= w[0] <= "Z" for w in own) / per]
        assert np.allclose(got[r.doc_id].posteriors, M._softmax(np.array([x]), model.center, model.slopes)[0])
        assert got[r.doc_id].n_tokens == len(own)
    assert got[1].posteriors[1] > 0.9 > 0.1 > got[3].posteriors[1] and got[149].posteriors[1] > 0.9


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    rows = M.mix(docs, labels, {"q0t0": 0.5, "q1t0": 0.5}, 2_000).collect()
    assert len(rows) == 155 and set(rows[0].asDict()) == {"doc_id", "text", *M.RESULTS}
    twice = [r for r in rows if r.doc_id == 0]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert {r.n_tokens for r in rows if r.doc_id in (200, 201)} == {0} and next(r.n_tokens for r in rows if r.doc_id == 202) == 30_000
    a, rate = totals(rows)
    assert np.abs(rate @ a - 1_000).max() <= 20


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x y", "k")], "doc_id long, text string, domain string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = M.mix(docs, labels).first()
    assert got.rate == 1.0 and got.miss is None and got.copies == 1
    known = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert M.mix(docs.limit(0), known).count() == 0
    assert M.mix(docs, known).first().rate == 1.0
