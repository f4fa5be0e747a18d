import re
import time

from pyspark.sql import functions as F

from toposcope.plans.catalog import capitalised_spans


def test_spans_of_capitalised_words_take_linear_time(spark):
    texts = ["", None, "no names", "Alt and Bern", "x Cal", "Dor.", "\u00e4 Elm, \U0001f600 Fal! USA Gol", "Har " * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    start = time.time()
    got = {r["i"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("i", capitalised_spans(F.col("text")).alias("s")).collect()}
    assert time.time() - start < 60
    assert got == {i: [m.span() for m in re.finditer(r"\b[A-Z][a-z]+\b", t or "")] for i, t in enumerate(texts)}
