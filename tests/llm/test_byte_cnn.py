import numpy as np
from pyspark.sql import functions as F

from toposcope.llm import byte_cnn as C
from toposcope.llm._shared import remainder

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    rows = C.identify(docs, ~held, keep_text=False).where(held).collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = C.ByteCnn(["a", "b", "c"])
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x, y = rng.integers(97, 120, (6, C.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = model.posteriors(x, model.tables()).astype(np.float64)
        return -np.log(p[np.arange(6), y]).mean()

    g = model._gradients(x, y)
    for k in ("conv3", "out", "bias"):
        flat = model.params[k].reshape(-1)
        i = int(np.abs(g[k]).reshape(-1).argmax())
        old = flat[i]
        flat[i] = old + 1e-2
        up = loss()
        flat[i] = old - 1e-2
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-2 - g[k].reshape(-1)[i]) < 0.1 * abs(g[k].reshape(-1)[i]) + 2e-3


def test_nulls_no_letters_and_clashing_names(spark):
    rows = [(1, "abc def " * 50, "xx", "mine"), (None, None, None, None), (3, "", "xx", None), (4, "123 !?", "yy", "m"), (5, "один два " * 9000, "yy", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in C.identify(df, F.lit(True)).collect()}
    assert [got[i].lang_pred for i in (None, 3, 4)] == ["und"] * 3
    assert got[1].lang_pred == "xx" and got[5].lang_pred == "yy" and 0 <= got[1].score <= 1
    assert {r.lang_pred for r in C.identify(df, F.lit(False)).collect()} == {"und"}
    assert C.identify(df.limit(0), F.lit(True)).count() == 0


def test_repeated_rows_and_ties(spark):
    rows = [(i, "abc def ghi " * 20, "xx") for i in range(6)] + [(i, "abc def ghi " * 20, "yy") for i in range(6, 12)] + [(0, "abc def ghi " * 20, "xx")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = C.identify(df, F.lit(True)).collect()
    assert len(got) == 52 and len({(r.lang_pred, r.score) for r in got}) == 1 and got[0].lang_pred in ("xx", "yy")
    assert {(r.lang_pred, r.score) for r in C.identify(df.repartition(3), F.lit(True)).collect()} == {(got[0].lang_pred, got[0].score)}
