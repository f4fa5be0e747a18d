import itertools
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toposcope.llm import deobfuscate as D
from toposcope.llm._shared import remainder

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def restorer():
    count = Counter()
    for w in "idiot moron trash scum clown loser worthless disgusting stupid the and thing reading bees apple good".split():
        s = f"^^{w}$"
        count.update(s[i : i + 3] for i in range(len(s) - 2))
    return D.Restorer(D.CharModel({k: float(v) for k, v in count.items()}))


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("tr@sh", "trash"), ("$tupid,", "stupid"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"), ("looossserrr", "loser"), ("c l 0 w n", "clown"), ("stuppid", "stupid")])
def test_restores(restorer, seen, meant):
    assert meant in restorer.words(f"so {seen} then")


def test_leaves_ordinary_text_alone(restorer):
    assert restorer.words("good bees 2023 !!! reading") == {"good", "bees", "reading"}


def ways(model, observed):
    """Cost of every way through the lattice, from the stated options of each sign."""
    runs = []
    for c in observed:
        runs.append((c, runs[-1][1] + 1 if runs and runs[-1][0] == c else 1))
    choices = []
    for i, (c, n) in enumerate(runs):
        last = max(m for d, m in itertools.takewhile(lambda x: x[0] == c, runs[i:]))
        choices.append(D.CharModel.options(c, n, n > 1 and last > 2))
    for way in itertools.product(*choices):
        spelt = "".join(letter for letter, _ in way)
        s = f"^^{spelt}$"
        yield sum(x for _, x in way) + sum(model.cost(s[k : k + 2], s[k + 2]) for k in range(len(s) - 2)), spelt


def test_decoding_is_exact(restorer):
    rng = random.Random(2)
    tokens = ["".join(rng.choice("aaoosstt1034$!@lm.") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    for token in [*tokens, "ssstttuuu", "1111", "1d10tt", "!!11ll"]:
        costs = dict.fromkeys((w for _, w in ways(restorer.model, token)), math.inf)
        for cost, spelt in ways(restorer.model, token):
            costs[spelt] = min(costs[spelt], cost)
        assert costs[restorer.model.decode(token)] == pytest.approx(min(costs.values()))


def test_held_out_and_obfuscated(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    learn = remainder(F.col("doc_id"), 4) != 2
    hidden = F.col("text")
    for word, seen in (("idiot", "1d10t"), ("scum", "s c u m"), ("stupid", "stuuupid"), ("trash", "tr@sh"), ("loser", "l0s3r"), ("moron", "m0r0n"), ("clown", "c.l.o.w.n"), ("pathetic", "p4thet1c"), ("disgusting", "d1sgust1ng"), ("worthless", "worth1ess")):
        hidden = F.regexp_replace(hidden, word, seen)
    mixed = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10**9).alias("doc_id"), hidden.alias("text")))
    mixed = mixed.unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string"))
    true = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    toxic, clean = sum(true.values()), len(true) - sum(true.values())
    hits, wrongs = {}, {}
    for restore in (True, False):
        got = {r.doc_id: r.score for r in D.score(mixed, labels, learn, restore=restore).collect()}
        assert got[None] < 0.3 and got[-1] < 0.3
        for shift in (0, 10**9):
            hits[restore, shift] = sum(got[i + shift] >= 0.3 for i, t in true.items() if t)
            wrongs[restore, shift] = sum(got[i + shift] >= 0.3 for i, t in true.items() if not t)
    print(toxic, clean, hits, wrongs)
    for shift in (0, 10**9):
        assert hits[True, shift] >= 0.85 * toxic and wrongs[True, shift] <= 0.02 * clean
        assert wrongs[True, shift] <= wrongs[False, shift] + 0.005 * clean
    assert hits[True, 10**9] >= hits[False, 10**9] + 0.1 * toxic


def test_odd_rows(spark):
    toxic = [(i, f"you idiot {i}", "x") for i in range(40)]
    clean = [(100 + i, f"the good reading {i}", "x") for i in range(80)]
    odd = [(900, "idiot " * 30_000, "x"), (901, "1d10t " * 2, "x"), (0, "you idiot 0", "x"), (902, None, "x"), (903, "the " * 50_000, "x"), (904, "A1" * 40_000, "x")]
    docs = spark.createDataFrame([*toxic, *clean, *odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, int(i < 100)) for i, _, _ in toxic + clean), (0, 1), (None, 1), (100, None), (999, 1)], "doc_id long, toxic int")
    rows = D.score(docs, labels, F.lit(True)).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == 126 and len({r.score for r in rows if r.doc_id == 0}) == 1
    assert got[900] == pytest.approx(got[901]) and min(got[1], got[901]) > 0.5 > got[100]
    assert got[902] == pytest.approx(got[904]) and got[903] == pytest.approx(got[902])


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert D.score(docs, labels, F.lit(True)).first().score == 0
    assert D.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_stretched_word_of_few_toxic_texts(spark):
    toxic = [(i, f"you idiot {i}") for i in range(12)]
    clean = [(100 + i, f"the good reading {i}") for i in range(60)]
    docs = spark.createDataFrame([*toxic, *clean, (900, "that idiot"), (901, "that iiidddiiiooottt"), (902, "that thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in D.score(docs, labels, F.lit(True)).collect()}
    assert got[901] == pytest.approx(got[900]) and got[901] > got[902]


def test_bounds_of_a_word_are_those_of_its_grams():
    rng = random.Random(4)
    letters = "abcß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 11))) for _ in range(300)]
    pool = sorted({g for w in words[:150] for g in D.grams(w)})
    bounds = {g: rng.random() for g in rng.sample(pool, len(pool) // 4)}
    telling = D.Telling(bounds, 0.1, D.Restorer(None))
    assert [telling.word(w) for w in words] == [max((bounds.get(g, 0.0) for g in D.grams(w)), default=0.0) for w in words]
    assert D.Telling({}, 0.1, D.Restorer(None)).word("abc") == 0.0


def test_every_labelled_text_is_learnt_from(spark, tmp_path):
    n = 8300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("note "), F.col("id").cast("string"), F.when(F.col("id") % 10 == 0, " scum").otherwise(" bees")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    path = f"file://{tmp_path}/s"
    scores = D.score(docs, labels, F.lit(True), path=path)
    assert spark.read.parquet(f"{path}/learnt").count() == n
    counts = {r["key"]: r.asDict() for r in spark.read.parquet(f"{path}/counts").where("key in ('scum', 'bees')").collect()}
    assert sum(counts["scum"][f"n{f}"] for f in range(D.FOLDS)) == n // 10
    low, high = scores.agg(F.max(F.when(F.col("doc_id") % 10 > 0, F.col("score"))), F.min(F.when(F.col("doc_id") % 10 == 0, F.col("score")))).first()
    assert low < 0.3 < high


def test_a_token_is_decoded_once_for_all_texts_and_lists(restorer):
    asked = []

    class Counted(D.CharModel):
        def decode(self, observed):
            asked.append(observed)
            return restorer.model.decode(observed)

    own = D.Restorer(Counted({}))
    counts = D.GramCounts(own)
    texts = [f"so 1d10t and m0r0n {i}" for i in range(30)]
    for i, text in enumerate(texts):
        counts.add(text, i % 2, i % D.FOLDS)
    assert sorted(asked) == ["1d10t", "m0r0n"]
    (batch,) = counts.packed()
    got = {r["key"]: r for r in batch.to_pylist()}
    assert set(got) == {g for w in ("so", "and", "idiot", "moron") for g in D.grams(w)}
    assert [got["^idiot$"][c] for c in D.COUNTS] == [10, 10, 10, 5, 5, 5]
    asked.clear()
    lists = [{"idiot": 0.5}, {"moron": 0.9, "idiot": 0.4}, {}]
    together = D.Telling(lists, 0.1, own)
    features = [together.features(t) for t in texts]
    assert sorted(asked) == ["1d10t", "m0r0n"]
    assert features == [[v for x in lists for v in D.Telling(x, 0.1, own).features(t)] for t in texts]


def test_texts_without_a_label_are_not_sent_to_the_join(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    ids = spark.range(0, 5000, 50).select(F.col("id").cast("int").alias("doc_id"))
    got = {r.doc_id for r in D._among(docs, ids).collect()}
    assert {*range(0, 5000, 50)} <= got and len(got) < 110
