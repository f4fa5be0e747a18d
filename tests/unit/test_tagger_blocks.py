import random
import time

import numpy as np
from pyspark.sql import functions as F

from toposcope.operators import tagger as G

TEXTS = ["", "to Altburg by", "< > <Élan> ÉLAN straße İx 東京 a1B2 A AA Aa", "Peter, to\nCalton... naïve", " "]


def test_features_of_blocks_are_those_of_tokens():
    words = G._Words(12)
    for _, features, starts, ends, first in G._blocks(((t,) for t in TEXTS), words):
        split = [G._tokens(t) for t in TEXTS]
        assert features.T.tolist() == [G._features(w, i, 12) for w, _ in split for i in range(len(w))]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [p for _, places in split for p in places]
        assert first.tolist() == [0, 3, 16]


def test_gold_tags_of_any_spans_are_those_of_the_definition():
    rnd = random.Random(3)
    for _ in range(200):
        ends = np.cumsum([rnd.randrange(1, 4) for _ in range(2 * rnd.randrange(1, 12))]).tolist()
        places = list(zip(ends[::2], ends[1::2], strict=True))
        spans = [(a, a + rnd.randrange(-1, 9)) for a in (rnd.randrange(ends[-1]) for _ in range(rnd.randrange(6)))]
        want = [0] * len(places)
        for a, b in sorted(spans):
            for n, i in enumerate([i for i, (s, e) in enumerate(places) if a <= s and e <= b]):
                want[i] = 2 if n else 1
        assert G.gold_tags(places, spans) == want


def test_a_long_text_of_many_spans_takes_time_in_proportion():
    places = [(4 * i, 4 * i + 3) for i in range(60_000)]
    began = time.process_time()
    assert G.gold_tags(places, places[::2]) == [1, 0] * 30_000
    assert time.process_time() - began < 5


def test_tags_follow_from_the_tag_before():
    rnd = np.random.default_rng(4)
    own = G.Weights(8, rnd.normal(size=((1 << 8) + 3) * 3).astype(np.float32) * np.r_[np.ones(3 << 8), np.full(9, 4)].astype(np.float32))
    words = [str(x) for x in rnd.integers(0, 30, 300)]
    rows, before, want = own.values.reshape(-1, 3).astype(float), 0, []
    for i in range(len(words)):
        before = int((rows[G._features(words, i, 8)].sum(0) + rows[(1 << 8) + before]).argmax())
        want.append(before)
    assert own.tag(words) == want and len(set(want)) == 3


def test_spans_over_batches_and_unknown_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 5)
    values = np.zeros(((1 << 10) + 3) * 3, np.float32)
    values[G._place("s=Xx", 10) * 3 + G.BEGIN] = 1
    docs = spark.range(40).select("id", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("by Ab and Cd "), F.col("id").cast("string"))).alias("text"))
    got = {r.id: r.spans if r.spans is None else [tuple(s) for s in r.spans] for r in G.PerceptronRecognizer(10, values)(docs).collect()}
    assert got == {i: None if i % 7 == 0 else [] if i % 5 == 0 else [(3, 5), (10, 12)] for i in range(40)}
