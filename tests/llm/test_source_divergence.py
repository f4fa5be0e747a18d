import random
import re
from collections import Counter, defaultdict

import duckdb

from toposcope.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    """Dense sums over all kept terms, in plain integers."""
    docs = [(t or "", g or "", s or "") for t, g, s in rows]
    by_lang, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = TERM.findall(text.translate(LOWER))
        by_lang[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in by_lang[lang].items() if n >= least]

        def rates(own, kept=kept):
            total = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (own[t] + 1) // total for t in kept}

        p = {s: rates(counts[lang, s]) for s in sources}
        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            mark = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", mark, top)):
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, i + 1))
    return sorted(out)


def report(spark, rows, schema="text string, lang string, source string"):
    audit = D.Audit(spark.createDataFrame(rows, schema))
    return sorted(map(tuple, D.ranked(audit.pairs(), "pair").unionByName(D.ranked(audit.terms(), "term", 200)).collect()))


def test_equals_dense_sums(spark):
    rnd = random.Random(5)
    words = ["der", "Über", "été", "K", "ſ", "naïve", "日本", "x1y", "don't"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((" ".join(words[int(rnd.paretovariate(0.6)) % len(words)].upper() if rnd.random() < 0.2 else words[int(rnd.paretovariate(0.6)) % len(words)] for _ in range(rnd.randrange(60))), rnd.choice(["de", "fr"]), source))
    rows += [rows[0]] * 50 + [(None, None, None), ("alone here", "xx", "one"), (None, "xx", "two"), ("", "de", "empty"), ("only", None, "n")]
    assert report(spark, rows) == brute(rows)


def test_equal_values_and_long_texts(spark):
    rows = [("b a c " * 3, "l", s) for s in ("s2", "s1", "s3")] + [("long " * 200_000 + "a", "l", "s1"), ("123 _ - ", "l", "s9")]
    assert report(spark, rows) == brute(rows)


def test_few_terms_held_in_a_task(spark, monkeypatch):
    """Passing counts on early changes nothing."""
    rows = [(f"w{chr(97 + i % 9)} x y z", "l", f"s{i % 3}") for i in range(60)]
    spread = list(D._count_task(iter(spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("binary(lang) l", "binary(source) s", "binary(text) t").toArrow().to_batches())))
    monkeypatch.setattr(D, "HELD", 5)
    early = list(D._count_task(iter(spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("binary(lang) l", "binary(source) s", "binary(text) t").toArrow().to_batches())))
    total = lambda batches: sum((Counter({(r["lang"], r["source"], r["term"]): r["n"] for r in b.to_pylist()}) for b in batches), Counter())
    assert len(early) > len(spread) and total(early) == total(spread)


def test_large_counts_stay_exact(spark):
    """Rates of counts whose product with the scale is beyond 64 bits."""
    n, total, kept = 10**13 + 7, 3 * 10**13 + 1, 10**6
    got = spark.range(1).selectExpr(f"{D._rate(f'{n}L', f'{total}L', f'{kept}L')} AS p").first().p
    assert got == 1 + 10**9 * (n + 1) // (total + kept)


def test_empty_table(spark):
    assert report(spark, []) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, D.op11_source_divergence(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(D.ORACLE_SQL).fetchall())
    assert {r[2] for r in got} == {"pair", "term"}
