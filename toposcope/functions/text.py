"""String functions for names and queries, as native column expressions where Spark has them."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def soundex(text: Column) -> Column:
    """American Soundex of the letters alone; '' without a letter.

    Letters outside A-Z count as vowels, and one in front stays as it is.
    """
    letters = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}]", "")
    plain = F.soundex(F.regexp_replace(letters, "[^A-Z]", "A"))
    rest = F.soundex(F.concat(F.lit("A"), F.regexp_replace(F.substring(letters, 2, 1 << 30), "[^A-Z]", "A")))
    odd = F.concat(F.left(letters, F.lit(1)), F.substring(rest, 2, 3))
    return F.when(letters == "", "").when(letters.rlike("^[A-Z]"), plain).otherwise(odd)


def normal_form(text: Column) -> Column:
    """Lower case, signs that are neither letters nor digits as spaces, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", " "))


def edit_distance(query: Column, candidate: Column) -> Column:
    return F.levenshtein(normal_form(query), normal_form(candidate))


def letter_set(text: Column) -> Column:
    """Which characters a text has, as 64 bits; characters may share one."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).otherwise(acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)).cast("int")))))


def least_distance(len_a: Column, set_a: Column, len_b: Column, set_b: Column) -> Column:
    """A lower bound of the edit distance, from lengths and letter sets: each edit adds and takes one letter at most."""
    lack = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return F.greatest(F.abs(len_a - len_b), lack(set_a, set_b), lack(set_b, set_a))


# fixed values: the usual parameters of BM25
K1, B = 1.2, 0.75


def saturation(f: Column, doc_len: Column, mean_len: Column) -> Column:
    """The part of BM25 that the frequency and the length of a text decide; it grows with f and falls with the length."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * doc_len / mean_len))


def clean_query(text: Column) -> Column:
    """Double quotes removed, then trimmed."""
    return F.trim(F.replace(text, F.lit('"'), F.lit("")))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def fold(text: str | None) -> list[str]:
    """Search tokens: lower case without diacritics; runs of letters, numbers and dots."""
    out, run = [], []
    for c in unicodedata.normalize("NFD", (text or "").lower()):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or c == "." or kind == "Co":
            run.append(c)
        elif kind[0] != "M" and run:
            out.append("".join(run))
            run = []
    if run:
        out.append("".join(run))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded(text: pd.Series) -> pd.Series:
    return text.map(fold)


def tokens(text: Column) -> Column:
    """Search tokens; plain ASCII texts are split in the JVM, others decomposed in Python."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.filter(F.split(F.lower(text), "[^a-z0-9.]+"), lambda x: x != "")).otherwise(_folded(text))


def inflections(text: Column, most: int = 3, stem: int = 3) -> Column:
    """A single word without its last 1..most letters, as long as `stem` letters stay."""
    name = F.trim(text)
    cut = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.when(F.length(name) - k >= stem, F.substring(name, F.lit(1), F.length(name) - k)))
    return F.when((name == "") | name.rlike(r"\s"), F.array().cast("array<string>")).otherwise(F.filter(cut, lambda x: x.isNotNull()))


def describe(name: Column, kind: Column, *levels: Column) -> Column:
    """`name (type) in level, level`: levels from the nearest to the widest, blanks left out."""
    places = F.filter(F.array(*levels), lambda x: x.isNotNull() & (F.trim(x) != ""))
    typed = F.when(kind.isNotNull() & (F.trim(kind) != ""), F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise("")
    within = F.when(F.size(places) > 0, F.concat(F.lit(" in "), F.array_join(places, ", "))).otherwise("")
    return F.concat(F.coalesce(name, F.lit("")), typed, within)


def population_prior(population: Column) -> Column:
    """log10(1 + p) / 10 for a positive number, else 0."""
    p = population.try_cast("double")
    return F.when((p > 0) & ~F.isnan(p), F.log10(1 + p) / 10).otherwise(F.lit(0.0))


def combined_score(similarity: Column, prior: Column, weight: float) -> Column:
    return similarity if weight == 0 else similarity + weight * prior


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when((size(a) > 0) & (size(b) > 0), dot / (size(a) * size(b))).otherwise(F.lit(0.0))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Half-open code-point span, counted from 0."""
    return F.substring(text, start + 1, end - start)


def module_id(name: str, **config) -> tuple[str, str]:
    """Eight hex digits that stand for a module and its settings, and the settings as JSON."""
    settings = json.dumps(json.loads(json.dumps(config, default=str)), sort_keys=True)
    shown = ", ".join(f"{k}={v!r}" for k, v in sorted(json.loads(settings).items()))
    return hashlib.sha256(f"{name}({shown})".encode()).hexdigest()[:8], settings


def marked_up(text: Column, spans: Column) -> Column:
    """text as HTML with each span (sorted, disjoint) in a mark element."""

    def escape(c: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    def step(acc: Column, s: Column) -> Column:
        gap = escape(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        own = escape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<mark>"), own, F.lit("</mark>")).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], escape(F.substring(text, done["at"] + 1, 1 << 30)))


def register(spark: SparkSession) -> None:
    """SQL names for users: edit_distance_ci(query, candidate) and name_soundex(text) as SQL functions."""
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION edit_distance_ci(a STRING, b STRING) RETURNS INT RETURN levenshtein(trim(regexp_replace(lower(coalesce(a, '')), '[^\\p{L}\\p{N}]', ' ')), trim(regexp_replace(lower(coalesce(b, '')), '[^\\p{L}\\p{N}]', ' ')))""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION name_soundex(x STRING) RETURNS STRING RETURN (
        SELECT CASE WHEN l = '' THEN '' WHEN l RLIKE '^[A-Z]' THEN soundex(regexp_replace(l, '[^A-Z]', 'A'))
        ELSE concat(left(l, 1), substring(soundex(concat('A', regexp_replace(substring(l, 2), '[^A-Z]', 'A'))), 2, 3)) END
        FROM (SELECT regexp_replace(upper(coalesce(x, '')), '[^\\p{L}]', '') AS l))""")
