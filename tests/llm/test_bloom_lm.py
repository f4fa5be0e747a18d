import math
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from toposcope.llm import bloom_lm as L
from toposcope.llm._shared import remainder

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["the cat sat", "The cat ran É", None, "", " \t\n", "a b c " * 3000, "the cat sat", "unseen words only here", "the dog sat\x00x y z"] * 4


def tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), None]


def frame(spark):
    rows = [(i if i != 11 else None, t, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_base_counts_equal_brute_force_and_both_ways_agree(spark):
    df = frame(spark)
    out = {}
    for limit, common in ((1 << 30, 3), (-1, 3), (0, L.COMMON), (1, 0)):
        got = L.score(df, remainder(F.col("doc_id"), 7) == 2, broadcast_limit=limit, common=common).collect()
        out[limit] = {r.doc_id: r for r in got}
    for i in out[0]:
        assert all(math.isclose(out[0][i].base_score, out[k][i].base_score, rel_tol=1e-9) and out[0][i].n_known == out[k][i].n_known for k in out)
    assert set(out[-1]) == {*range(len(TEXTS))} - {11} | {None}
    rows = {(i if i != 11 else None): t for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i in rows}
    c = Counter(w for i, t in rows.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows.items():
        a, b = out[1 << 30][i], out[-1][i]
        assert a.held_out == held[i] and a.n_tokens == len(tokens(t)) and a.train_tokens == n
        assert a.n_known == sum(c[w] > 0 for w in tokens(t))
        assert math.isclose(a.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert math.isclose(a.score, b.score, rel_tol=1e-12) and a.score < 0


def test_filter_never_reads_a_level_too_low():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    levels = L.level_of(keys, rng.integers(1, 5000, len(keys)), L.PAIR_SCALE)
    for probes in (1, 5, 12):
        bits, false = L.LogBloom.part(keys, levels, probes)
        bloom = L.LogBloom({0: bits}, 1, {0: probes})
        got = bloom.levels(keys)
        assert (got >= levels).all() and ((got == levels).mean() > 0.95 or probes == 1)
        other = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
        assert abs((bloom.levels(other) > 0).mean() - false) < 0.004 and false < 0.6**probes


def test_quantised_counts_are_unbiased():
    rng = np.random.default_rng(1)
    for scale in (L.WORD_SCALE, L.PAIR_SCALE):
        assert (np.diff(scale) > 0).all() and len(scale) <= 256
        for count in (1, 2, 3, 5, 7, 23, 1000, 12345, 10**12):
            keys = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
            read = scale[L.level_of(keys, np.full(len(keys), count), scale)]
            assert abs(read.mean() / count - 1) < 0.01 and np.abs(read / count - 1).max() < 0.7


def test_score_equals_brute_force_with_exact_counts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 90, 12)) for _ in range(12)] + ["w1 w2", None, "new w3 w4", "w5 new2 w5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {i: i >= 11 for i in range(len(texts))}
    one, two, n, v = Counter(), Counter(), 0, 0
    for i, t in enumerate(texts):
        if not held[i]:
            one.update(tokens(t))
            two.update(zip(["<", *tokens(t)], tokens(t), strict=False))
    n, v, starts = sum(one.values()), len(one), sum(not h for h in held.values())
    assert max(c for w, c in one.items() if w) <= 6 and max(two.values()) <= 2  # up to that quantised counts are exact
    end = L.WORD_SCALE[L.level_of(np.array([L.END]), np.array([one[None]]), L.WORD_SCALE)[0]]
    assert end == one[None] == 11
    for limit, common in ((1 << 30, 0), (-1, 0), (-1, 20)):
        got = {r.doc_id: r.score for r in L.score(df, F.col("doc_id") >= 11, broadcast_limit=limit, false_count=1e-9, word_probes=30, common=common).collect()}
        for i, t in enumerate(texts):
            want = 0.0
            for u, w in zip(["<", *tokens(t)], tokens(t), strict=False):
                before = starts if u == "<" else one[u]
                single = (one[w] + 1) / (n + v + 1)
                want += math.log10((min(two[u, w], before) + 100 * single) / (before + 100) if before else single)
            assert math.isclose(got[i], want, rel_tol=1e-6), i


def test_probabilities_sum_to_one(spark):
    """Over the known words and the unknown one, after contexts of every frequency."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    segments = 3
    import tempfile

    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stored = L.train(docs, segments, f"{path}/m")
    split = L.split_words(stored, f"{path}/s", common=2000).collect()
    parts, common = stored.collect(), L.Common(split)
    filters = L.Filters(split, parts, segments)
    assert 1000 < len(common.keys) <= 2000
    tokens, distinct = sum(r.tokens for r in parts), sum(r.distinct for r in parts)
    model = L.Model(tokens, distinct, docs.count(), 100.0, distinct * sum(r["false"] for r in parts) / segments)
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in parts])
    counts = np.concatenate([L._unpacked(r["counts"], len(r["keys"]) // 8) for r in parts])
    own = common.of(keys).astype(float)
    own[own < 0] = L.WORD_SCALE[filters.levels(L.WORDS, keys[own < 0])]
    rng = np.random.default_rng(5)
    for low, high in ((1, 1), (2, 10), (11, 100), (101, 1000), (1001, 10**9)):
        at = np.flatnonzero((counts >= low) & (counts <= high) & (keys != L.END))
        mass = []
        for i in rng.permutation(at)[:40]:
            pair = L.PAIR_SCALE[filters.levels(L.PAIRS, L.mix(keys[i : i + 1] * L._PAIR + keys) & L.PAIR_BITS)]
            before = np.full(len(keys), own[i])
            unknown = model.probability(own[i : i + 1], np.zeros(1), np.zeros(1))[0]
            mass.append(model.probability(before, own, pair).sum() + unknown)
        print(low, high, np.mean(mass), np.std(mass))
        assert abs(np.mean(mass) - 1) <= 0.02, (low, high, np.mean(mass))


def test_repeated_documents_are_told_apart(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 60)) for _ in range(400)]
    rows = list(enumerate(texts + texts[:40]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in L.score(df, F.col("doc_id") < 0).collect()}
    once, twice = [gain[i] for i in range(40, 400)], [gain[i] for i in range(40)]
    assert np.mean([[a > b for b in once] for a in twice]) >= 0.98


def test_no_rows_and_no_training_rows(spark):
    df = frame(spark)
    assert L.score(df.limit(0), F.lit(False)).count() == 0
    got = L.score(df, F.lit(True)).collect()
    assert len(got) == len(TEXTS) and all(r.base_score == 0 and r.n_known == 0 for r in got)


def test_packed_pair_keys():
    rng = np.random.default_rng(6)
    for keys in (rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.array([1 << 16, 1 << 63], np.uint64), np.array([7 << 16], np.uint64)):
        keys = np.unique(keys & L.PAIR_BITS)
        assert (L._unpacked_keys(L._packed_keys(keys)) == keys).all()
