from collections import Counter

import duckdb
import pytest
import regex

from toposcope.llm import token_rollups as R

TOKENIZERS = {R.WORDS: None, "bpe": R.BPE_FILE}


def totals_of(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def totals(rollup):
    return totals_of(rollup.totals())


def test_signed_batches_are_additive_and_idempotent(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {}
    rows = [("a", "en", "one two three"), ("a", "en", "one two three"), ("b", None, "x  y"), (None, "de", None), ("a", "fr", "été 😀 " * 3000)]
    df = spark.createDataFrame([(*r, "mine", -7) for r in rows], "source string, lang string, text string, tokenizer string, sign int").select("source", "lang", "text")
    load = R.revision(df.limit(0), df)
    assert rollup.commit("load", load, TOKENIZERS) and not rollup.commit("load", load, TOKENIZERS)
    want = Counter()
    counters = {name: R.Counter(R.read_ranks(p) if p else None) for name, p in TOKENIZERS.items()}
    docs = Counter()
    for s, lang, t in rows:
        for name, c in counters.items():
            want[s, lang, name] += c(t)
            docs[s, lang, name] += 1
    assert totals(rollup) == {k: (docs[k], want[k]) for k in docs}
    old = spark.createDataFrame([rows[2]], df.schema)
    new = spark.createDataFrame([("b", None, "x y z")], df.schema)
    gone = spark.createDataFrame([rows[3]], df.schema)
    assert rollup.commit("fix", R.revision(old, new).unionByName(R.revision(gone, gone.limit(0))), TOKENIZERS)
    got = totals(rollup)
    assert got["b", None, R.WORDS] == (1, 3) and (None, "de", R.WORDS) not in got
    rollup.compact("base")
    assert totals(rollup) == got
    more = spark.createDataFrame([("c", "en", "one two")], df.schema)
    assert rollup.commit("more", R.revision(more.limit(0), more), TOKENIZERS)
    got = totals(rollup)
    assert got["c", "en", R.WORDS] == (1, 2)
    for used in ("base", "more", "fix"):
        with pytest.raises(ValueError, match="has been used"):
            rollup.compact(used)
        assert totals(rollup) == got
    rollup.compact("base2")
    assert totals(rollup) == got
    assert not rollup.commit("fix", load, TOKENIZERS) and totals(rollup) == got


def test_two_writers_and_a_lost_marker_count_once(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([("a", "en", "one two")], "source string, lang string, text string")
    delta = R.deltas(R.revision(df.limit(0), df), {R.WORDS: None})
    delta.write.parquet(f"file://{tmp_path}/r/deltas/load-lost")  # an attempt that ended before its marker
    assert totals(rollup) == {}
    rollup._write("load", delta, [])
    rollup._write("load", delta, [])  # another writer that had seen no marker
    assert totals(rollup) == {("a", "en", R.WORDS): (1, 2)}


def test_empty_batch(spark, tmp_path):
    rollup = R.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([], "source string, lang string, text string")
    assert rollup.commit("none", R.revision(df, df), TOKENIZERS) and not rollup.commit("none", R.revision(df, df), TOKENIZERS)
    assert totals(rollup) == {}
    rollup.compact("base")
    assert totals(rollup) == {}


def test_word_totals_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {k[:2]: v for k, v in totals_of(R.op5_token_rollups(spark, "/root/testdata/sf0.01")).items() if k[2] == R.WORDS}
    words = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda w: w <> ''))"
    want = duckdb.sql(f"select source, lang, count(*), sum({words}) from '{path}' group by all").fetchall()
    assert got == {(s, lang): (n, t) for s, lang, n, t in want}


def test_byte_pairs_join_by_least_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b" a": 259}
    counter = R.Counter(ranks)

    def brute(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return len(parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for text in ("abc", "bcab abc", "aabbcc", " a", "xyz abcabc bc"):
        pieces = regex.findall(R.PATTERN, text)
        assert "".join(pieces) == text and counter(text) == sum(brute(p.encode()) for p in pieces)
