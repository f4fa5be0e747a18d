import numpy as np
import pytest
from pyspark.sql import functions as F

from toposcope.llm import permutation_index as P


def brute(ids, x, k=5):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (u * u[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def recall(df, **options):
    pdf = df.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.array([np.asarray(v, float) for v in pdf["embedding"]]))
    got: dict = {}
    for r in P.search(df, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(set(v)) == len(v) for v in got.values())
    return sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")


def test_recall_on_the_given_table(spark):
    found = recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    print("recall", found)
    assert found >= 0.9


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_recall_on_made_vectors(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 48))
    if kind == "clustered":  # a third of all rows lies in one small cone
        x = rng.normal(size=(40, 48))[np.where(rng.random(6000) < 0.33, 0, rng.integers(1, 40, 6000))] + 0.4 * x
    monkeypatch.setattr(P, "SEGMENT", 1000)
    monkeypatch.setattr(P, "QUERY_BLOCK", 20)
    found = recall(frame(spark, x))
    print("recall", kind, found)
    assert found >= 0.9


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(1)
    orders = np.stack([rng.permutation(10) for _ in range(6)])
    at = P.ranks(orders)
    for i in range(6):
        want = [sum(abs(min(5, orders[i].tolist().index(p)) - min(5, orders[j].tolist().index(p))) for p in range(10)) for j in range(6)]
        assert P.footrule(at[i], at).tolist() == want


def test_everything_visited_is_exact(spark):
    x = np.random.default_rng(2).normal(size=(400, 6))
    assert recall(frame(spark, x), pivots=30, visit=30, share=1.0) == 1.0


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [3.0, 0.0]), (None, [1.0, 0.0]), (9, None), (10, [0.0, 0.0]), (11, [float("nan"), 1.0]), (12, [None, 1.0]), (13, [float("inf"), 1.0]), (14, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, pivot string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in P.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 7), (0, 3, 50), (50, 1, 0), (50, 2, 3), (50, 3, 7)]
    assert P.search(df.limit(0), F.lit(True)).count() == 0


def test_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 3)) for r in P.search(df, F.col("vec_id") % 50 == 0, k=2).collect())
    assert got == [(1, 1, 0.995), (1, 2, 0.995), (2, 2, 0.1), (2, 2, 0.995)]
    assert {r.query_id for r in P.search(df, F.col("vec_id") % 50 == 0).collect()} == {50}
