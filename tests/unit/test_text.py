import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toposcope.functions import context, text

CODES = {"Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Robert": "R163", "Rupert": "R163", "Honeyman": "H555", "Washington": "W252", "Lee": "L000", "Bwb": "B000", "Bab": "B100", "O'Brien": "O165", "OBrien": "O165", "": "", "123": ""}


def test_soundex(spark):
    df = spark.createDataFrame([(k,) for k in CODES], "x string").withColumn("c", text.soundex(F.col("x")))
    assert {r.x: r.c for r in df.collect()} == CODES


def test_edit_distance(spark):
    rows = [("kitten", "SITTING", 3), (None, "abc", 3), (None, None, 0), ("Saint-Denis", "saint denis", 0)]
    df = spark.createDataFrame(rows, "a string, b string, d int")
    assert df.where(text.edit_distance(F.col("a"), F.col("b")) != F.col("d")).count() == 0
    text.register(spark)
    assert spark.sql("select edit_distance_ci('kitten', 'SITTING') d, name_soundex('Robert') s").first() == (3, "R163")


def test_tokens(spark):
    rows = ["St. Étienne-du-Mont", "foo_bar-baz", "ß ø ł ²½", "東京 都", "...", None, "!!", "A  b"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select(text.tokens(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == [["st.", "etienne", "du", "mont"], ["foo", "bar", "baz"], ["ß", "ø", "ł", "²½"], ["東京", "都"], ["..."], [], [], ["a", "b"]]


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.inflections(F.lit("Berlins")).alias("i"),
        text.inflections(F.lit("New York")).alias("j"),
        text.describe(F.lit("Paris"), F.lit("city"), F.lit(""), F.lit("Texas"), F.lit("USA")).alias("d"),
        text.clean_query(F.lit('  "Paris"  ')).alias("q"),
        text.unix_newlines(F.lit("a\r\nb\rc")).alias("n"),
        text.population_prior(F.lit("x")).alias("p0"),
        text.population_prior(F.lit("999")).alias("p"),
        text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"),
        text.marked_up(F.lit("a <b> c"), F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")))).alias("m"),
        text.span_text(F.lit("😀 Paris"), F.lit(2), F.lit(7)).alias("s"),
    ).first()
    assert got.i == ["Berlin", "Berli", "Berl"] and got.j == []
    assert got.d == "Paris (city) in Texas, USA" and got.q == "Paris" and got.n == "a\nb\nc"
    assert got.p0 == 0 and abs(got.p - 0.3) < 1e-12 and abs(got.c - 0.5**0.5) < 1e-12
    assert got.m == "a <mark>&lt;b&gt;</mark> c" and got.s == "Paris"
    assert text.module_id("M", b=1, a=2) == text.module_id("M", a=2, b=1) and len(text.module_id("M")[0]) == 8


@pytest.mark.parametrize(("costs", "budget", "target", "want"), [([2, 2, 2], 10, 1, (0, 2)), ([3] * 5, 9, 2, (1, 3)), ([4, 2, 4], 6, 1, (0, 1)), ([2] * 4, 6, 0, (0, 2)), ([2, 50, 2], 10, 1, (1, 1))])
def test_window(costs, budget, target, want):
    assert context.window(costs, target, budget) == want
    with pytest.raises(ValueError):
        context.window(costs, len(costs), budget)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 40), st.data())
def test_window_stays_in_budget(costs, budget, data):
    target = data.draw(st.integers(0, len(costs) - 1))
    a, b = context.window(costs, target, budget)
    assert a <= target <= b and (sum(costs[a : b + 1]) <= budget or a == b == target)
