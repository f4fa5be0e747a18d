"""How far the sources of a language diverge: chi-square of smoothed term rates, exact.

Each language keeps the terms that occur in at least LEAST_DOCS of its documents, V of
them.  A group (language and source) gives every kept term the rate
p = 1 + floor(SCALE * (count + 1) / (N + V)), where N is its count of kept terms; so does
the language as a whole.  The divergence of rates p from rates q at a term is
floor((p - q)^2 / q).

Sums over all kept terms for all pairs of groups come by inclusion and exclusion over the
terms that groups have (their supports), so no group is ever filled up with zeros.  With
z for the rate of a count of 0, the sum over the V terms is

    (V - |A| - |B|) * f(zA, zB)                            as if no term had both
  + sum over A of f(p, zB) + sum over B of f(zA, q)        one-sided terms, from histograms
  + sum over A and B of f(p, q) - f(p, zB) - f(zA, q) + f(zA, zB)      the overlap

One-sided terms are priced by the histogram of a group's rates, once for each rate zB
of the language's other groups.  The overlap joins the postings of a term; a posting whose
rate is that of a count of 0 adds nothing there and stays out.

Terms are counted in tasks and summed there before they are shuffled.  Rates are made in
decimals, all else is 64-bit: the sums of f stay below (SCALE + V)^2.

Defined results: null text, language and source are empty texts; a group without terms
has N = 0; a language that keeps no term gives its pairs the value 0 and no term rows;
repeated rows count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.llm._shared import scratch, small_batches, stash, table

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: distinct terms that a task holds before it passes them on
HELD = 1 << 19
#: letters A to Z become lower-case, other ASCII bytes that are no letters become spaces
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) as bytes to counts of terms by group, with the texts that hold each."""
    groups: dict = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            terms = text.translate(LETTERS).split()
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held >= HELD:
                yield from _counted(groups)
                groups, held = {}, 0
    yield from _counted(groups)


def _counted(groups: dict) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    for (lang, source), (n, docs) in groups.items():
        terms = list(n)
        for i in range(0, len(terms), 1 << 16):
            part = terms[i : i + (1 << 16)]
            cols = ([lang] * len(part), [source] * len(part), part, [n[t] for t in part], [docs[t] for t in part])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])


def _rate(n: str, total: str, kept: str) -> str:
    return f"1 + cast({n} + 1 as decimal(20, 0)) * {SCALE} div cast({total} + {kept} as decimal(20, 0))"


def _f(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


class Audit:
    """Written counts of documents (text, lang, source), from which the reports are made."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        spark = docs.sparkSession
        small_batches(spark)
        path = scratch(spark)
        plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        parts = plain.select(*[F.col(c).cast("binary") for c in plain.columns]).mapInArrow(_count_task, "lang binary, source binary, term binary, n long, docs long")
        counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # one more shuffle, of summed counts: what a language has of a term, and whether it is kept
        own = Window.partitionBy("lang", "term")
        first = F.row_number().over(own.orderBy("source")) == 1
        named = counts.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")
        spread = named.select("lang", "source", "term", "n", F.sum("n").over(own).alias("n_lang"), F.sum("docs").over(own).alias("held_by"), first.alias("first"))
        self._counts = stash(spread.where(F.col("held_by") >= least_docs).drop("held_by"), f"{path}/counts")

        langs = self._counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("total_lang"))
        sums = self._counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
        zero = F.when(F.col("kept") > 0, F.expr(_rate("0L", "total", "kept"))).otherwise(1)
        groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        #: lang, source, total, support, kept, total_lang, zero
        self.groups = stash(groups.withColumn("zero", zero), f"{path}/groups")
        #: lang, source, term, n, p and q, the rates of the group and of the language
        self.postings = (
            self._counts.join(self.groups.drop("support"), ["lang", "source"])
            .withColumn("p", F.expr(_rate("n", "total", "kept")))
            .withColumn("q", F.expr(_rate("n_lang", "total_lang", "kept")))
        )

    def _prices(self) -> DataFrame:
        """For each group and each rate `other` that a zero count has in its language: its support against that rate."""
        histogram = self.postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
        others = self.groups.select("lang", F.col("zero").alias("other")).distinct()
        priced = histogram.join(others, "lang")
        return priced.groupBy("lang", "source", "other").agg(
            F.sum(F.expr(f"terms * ({_f('p', 'other')})")).alias("as_p"), F.sum(F.expr(f"terms * ({_f('other', 'p')})")).alias("as_q")
        )

    def _overlaps(self) -> DataFrame:
        """Corrections for the terms that both groups have, in both directions (lang, source, item, overlap)."""
        rows = self.postings.where("p <> zero")
        a, b = (rows.select("lang", "term", F.col("source").alias(f"s{x}"), F.col("p").alias(f"p{x}"), F.col("zero").alias(f"z{x}")) for x in "ab")
        both = a.join(b, ["lang", "term"]).where("sa < sb")

        def terms(x: str, y: str) -> str:
            return f"({_f(f'p{x}', f'p{y}')}) - ({_f(f'p{x}', f'z{y}')}) - ({_f(f'z{x}', f'p{y}')}) + ({_f(f'z{x}', f'z{y}')})"

        sums = both.groupBy("lang", "sa", "sb").agg(F.sum(F.expr(terms("a", "b"))).alias("ab"), F.sum(F.expr(terms("b", "a"))).alias("ba"))
        return sums.select("lang", F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item"), F.col("ab").alias("overlap")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item"), F.col("ba").alias("overlap")))).alias("x")).select("lang", "x.*")

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language), value."""
        own = self.groups.select("lang", "source", "support", "kept", "zero")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("support").alias("item_support"), F.col("zero").alias("item_zero"))
        prices = self._prices()
        left = prices.select("lang", "source", F.col("other").alias("item_zero"), "as_p")
        right = prices.select("lang", F.col("source").alias("item"), F.col("other").alias("zero"), "as_q")
        rows = (
            own.join(other, "lang").where("source <> item")
            .join(left, ["lang", "source", "item_zero"], "left").join(right, ["lang", "item", "zero"], "left")
            .join(self._overlaps(), ["lang", "source", "item"], "left").na.fill(0, ["as_p", "as_q", "overlap"])
        )
        apart = f"(kept - support - item_support) * ({_f('zero', 'item_zero')})"
        return rows.select("lang", "source", "item", F.expr(f"{apart} + as_p + as_q + overlap").alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item (terms that the group has more often than its language), value."""
        return self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Ranks within each group, by falling value, then by item; only up to `most`."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.withColumn("rank", rank)
    if most is not None:
        out = out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language by divergence, and the TOP_TERMS terms that mark each source most."""
    audit = Audit(table(spark, sf_dir, "documents"))
    return ranked(audit.pairs(), "pair").unionByName(ranked(audit.terms(), "term", TOP_TERMS))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    bydoc AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
    kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n_lang FROM bydoc GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
    langs AS (SELECT lang, count(*) AS v, CAST(sum(n_lang) AS BIGINT) AS total_lang FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counts AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM bydoc GROUP BY ALL),
    grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM grid GROUP BY ALL),
    rates AS (SELECT lang, source, term, n, 1 + {SCALE} * (n + 1) // (total + v) AS p, 1 + {SCALE} * (n_lang + 1) // (total_lang + v) AS q FROM grid JOIN totals USING (lang, source) JOIN langs USING (lang)),
    pairs AS (SELECT g.lang, g.source, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
        ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
    marks AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM rates WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM marks))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
