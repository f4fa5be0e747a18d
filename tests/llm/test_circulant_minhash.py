import random
import re

import pytest

from toposcope.llm import circulant_minhash as M
from toposcope.llm.components import connected, joined

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t, width):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return frozenset()
    size = min(width, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):  # families whose members differ about as much as the threshold allows
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 14])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((i, " ".join(own).title() if rng.random() < 0.2 else " ".join(own)))
            i += 1
    shared = " ".join(rng.choice(vocab) for _ in range(40))  # a passage that many share
    for _ in range(60):
        rows.append((i, shared + " " + " ".join(rng.choice(vocab) for _ in range(20))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "x " * 30000), (i + 6, "x x")]
    return rows


def two_versions(seed):
    """Groups of copies in two versions of one text about as far apart as the threshold allows, bridged or not."""
    rng = random.Random(seed)
    vocab, rows, i = [f"v{k}" for k in range(300)], [], 0
    for size in (60, 90):
        one = [rng.choice(vocab) for _ in range(80)]
        two = list(one)
        for at in rng.sample(range(80), 4):
            two[at] = rng.choice(vocab)
        for _ in range(size):
            own = list(one if rng.random() < 0.5 else two)
            for at in rng.sample(range(80), rng.randrange(1, 6)):
                own[at] = rng.choice(vocab)
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_in_two_versions(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "FIRST", 1)
    monkeypatch.setattr(M, "BLOCK", 7)
    rows = two_versions(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5):
        want = brute(rows, width)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.components(df, width=width).collect()} == want


@pytest.mark.parametrize(("width", "block", "elements", "first"), [(2, 4096, 2_000_000, 8), (2, 4, 300, 1)])
def test_components_equal_brute_force(spark, monkeypatch, width, block, elements, first):
    monkeypatch.setattr(M, "FIRST", first)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "ELEMENTS", elements)
    joining = []
    whole = M._seek_task
    monkeypatch.setattr(M, "_seek_task", lambda limit, percent: joining.append(limit) or whole(limit, percent))
    rows = corpus()
    extra = [(None, "null id"), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows + extra], "doc_id long, text string, n string")
    got = M.components(df, width=width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == want[r.doc_id][1])
    assert joining == [first, None]


def test_empty_table(spark):
    assert M.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_long_chain_and_further_links(spark, tmp_path, most):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = connected(links, f"file://{tmp_path}/cc", broadcast_edges=most)
    want = {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert {r.node: r.label for r in labels.collect()} == want
    more = joined(labels, spark.createDataFrame([(101, 7), (200, 201), (3, 4)], "a long, b long"), f"file://{tmp_path}/more")
    assert {r.node: r.label for r in more.collect()} == {**want, 100: 0, 101: 0, 200: 200, 201: 200}


def test_each_pair_with_a_pending_end_meets(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, 1, 0, True), (1, 2, 0, False), (1, 3, 3, False)]  # bucket, rid, component, pending: 1 waits in the largest component
    for bucket in range(2, 12):
        rows += [(bucket, 100 * bucket + i, rng.choice([0, 0, 0, 1, 2]), rng.random() < 0.3) for i in range(30)]
    df = spark.createDataFrame([(b, 0, r, c, 5, bytes(2 * M.COORDINATES), p) for b, r, c, p in rows], "bucket long, band int, rid long, comp long, n long, sig binary, pending boolean")
    for block, elements, with_sets in ((7, 10**9, False), (10**9, 40, True), (4096, 10**6, True)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "ELEMENTS", elements)
        met, blocks = set(), {}
        for r in M._blocks(df, with_sets).collect():
            blocks.setdefault((r.bucket, r.chunk, r.part), ([], []))[r.seeks].append(r.rid)
        for targets, seekers in blocks.values():
            met |= {frozenset((x, y)) for x in seekers for y in targets}
        for b, r, c, p in rows:
            for b2, r2, c2, p2 in rows:
                if b == b2 and c != c2 and (p or p2):
                    assert frozenset((r, r2)) in met


def test_a_new_largest_component_is_still_sought(spark):
    # 1-3 waited as the largest component in round one; 4-7 have become the largest, and 4 is still pending
    rows = [(i, 1, False) for i in (1, 2, 3)] + [(4, 4, True)] + [(i, 4, False) for i in (5, 6, 7)]
    df = spark.createDataFrame([(1, 0, r, c, 5, bytes(2 * M.COORDINATES), p) for r, c, p in rows], "bucket long, band int, rid long, comp long, n long, sig binary, pending boolean")
    got = M._blocks(df, True).collect()
    assert {r.rid for r in got if r.seeks} == {1, 2, 3} and {r.rid for r in got if not r.seeks} == set(range(1, 8))
