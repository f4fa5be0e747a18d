import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from toposcope.llm import max_tree_search as M

TERM = re.compile(M.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Every document scored for every item."""
    own = [(d, Counter(t), len(t)) for d, t in ((d, terms_of(x)) for d, x in docs) if t]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    by_item = {}
    for item, text in dict.fromkeys(items):
        by_item.setdefault(item, []).extend(terms_of(text))
    out = []
    for item, terms in by_item.items():
        scores = []
        for d, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=1, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, M.ranked_search(d, spark.createDataFrame(items, "item_id string, text string"), **more).collect()), key=str)


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = ["Über", "été", "日本", "x1", "A"] + [f"w{i}" for i in range(300)]
    draw = lambda k: " ".join(words[min(len(words) - 1, int(rnd.paretovariate(0.5)) - 1)] for _ in range(k))
    docs = [(i, draw(rnd.randrange(1, 40))) for i in range(n)]
    items = [(f"i{j}", draw(rnd.randrange(1, 12))) for j in range(12)]
    return docs, items


def test_equals_brute_force_with_copies_and_ties(spark):
    docs, items = corpus(900)
    docs += [(5000 + i, docs[4][1]) for i in range(300)] + [docs[7]] * 15 + [(None, docs[9][1]), (None, None), (6000, ""), (6001, "?! _")]
    items += [("copy", docs[4][1]), ("row", docs[7][1]), ("none", "?"), ("null", None), (None, docs[9][1]), ("unknown", "zzzz"), items[0], ("i1", "w3 w3")]
    assert run(spark, docs, items, parts=3) == brute(docs, items)


def test_small_segments_and_many_parts_change_nothing(spark, monkeypatch):
    docs, items = corpus(700, 8)
    want = brute(docs, items)
    assert run(spark, docs, items, part_bytes=60) == want


def test_segments_and_bounds_of_the_tree(monkeypatch):
    """In one segment: bounds hold for all ranges, few leaf ranges are opened, and the result is exact."""
    docs, items = corpus(4000, 11)
    held = M._Segment()
    for d, t in docs:
        words = t.encode().translate(M.ALNUM).split()
        held.add(d, len(words), Counter(words))
    row = held.row(0, M._lists(M.SEGMENTS))
    (batch,) = M._tree_task(held.n_docs, held.n_terms)(iter([row]))
    tree = M._Tree(batch, 0)
    terms = batch.column(2)[0].as_py()
    opened = 0
    for _, text in items:
        own = Counter(x.encode() for x in terms_of(text))
        rows = np.array([i for i, t in enumerate(terms) if t in own])
        weight = np.array([own[terms[i]] * math.floor(1000 * math.log((2 * held.n_docs + 2) / (2 * len(held.postings[terms[i]][0]) + 1))) for i in rows])
        exact = np.zeros(len(docs), np.int64)
        start = np.r_[0, np.cumsum(row.column(6)[0].values.to_numpy())]
        for r, w in zip(rows, weight, strict=True):
            e = slice(start[r], start[r + 1])
            exact[tree.place[e]] += w * tree.score[e]
        for k in (0, 1):
            bounds = tree._level(k, rows, weight)[2]
            assert all(bounds[p >> M.SHIFTS[k]] >= s for p, s in enumerate(exact))
        found = M._Found(0)
        opened += tree.search(rows, weight, found)
        best = sorted(((-s, d) for s, (d, _) in zip(exact, docs, strict=True) if s > 0))[:10]
        assert sorted((-x[0], -x[2]) for x in found.heap) == best
    assert opened < 0.6 * len(items) * len(docs) / 16


def test_full_segments_end(monkeypatch):
    monkeypatch.setattr(M, "SEGMENT", 8)
    held = M._Segment()
    for i in range(8):
        held.add(i, 2, Counter([b"a", b"b"]))
    assert held.full() and isinstance(held.row(1, M._lists(M.SEGMENTS)), pa.RecordBatch)


def test_empty_tables_and_long_texts(spark):
    docs, items = corpus(5)
    assert run(spark, [], items) == [] == run(spark, docs, [])
    assert run(spark, [(1, None)], items) == []
    long = [(1, "w1 " * 300_000 + "rare"), (2, "rare w2"), (3, "w1")]
    assert run(spark, long, [("a", "rare"), ("b", "w1 " * 5000)]) == brute(long, [("a", "rare"), ("b", "w1 " * 5000)])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, M.op13_max_tree_search(spark, sf).collect()))
    assert got == sorted(con.execute(M.ORACLE_SQL).fetchall()) and got
