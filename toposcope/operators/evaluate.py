"""Span, distance and protocol metrics.

Annotations are rows (document_id, start, end) with identifier, latitude and longitude
where known.  Spans count once however often they occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toposcope.functions.geo import haversine_km
from toposcope.operators.scratch import written

SPAN = ["document_id", "start", "end"]
WORST_KM = 20039.0


def ratio(over: Column, under: Column, empty: float) -> Column:
    return F.when(under == 0, F.lit(empty)).otherwise(over / under)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def check_annotations(df: DataFrame) -> DataFrame:
    """Rows that break a rule: 0 <= start < end, both coordinates or neither, within range."""
    half = F.col("latitude").isNull() != F.col("longitude").isNull()
    far = (F.abs("latitude") > 90) | (F.abs("longitude") > 180)
    order = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end"))
    return df.where(order | half | F.coalesce(far, F.lit(False)))


def gold_conflicts(gold: DataFrame) -> DataFrame:
    """Spans with two identifiers or two coordinates: an error in the gold."""
    place = F.when(F.col("latitude").isNotNull(), F.struct("latitude", "longitude"))
    return gold.groupBy(*SPAN).agg(F.count_distinct("identifier").alias("ids"), F.count_distinct(place).alias("places")).where("ids > 1 or places > 1")


#: rows that one task matches, about: its memory does not grow with the tables
MATCHED_AT_ONCE = 1 << 18


def matched(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct row of keys, with g and p: whether gold and predicted have it.

    Both sides are sent once, to as many tasks as their rows need.  As in a join, a key
    with a null is not that of the other side.
    """
    whole = F.concat(*[F.col(c).isNull().cast("string") for c in keys]) == "false" * len(keys)
    side = lambda df, own: df.select(*keys, F.lit(own).alias("g"), F.when(~whole, own).alias("__apart"))
    rows = side(gold, True).unionByName(side(predicted, False))
    tasks = max(gold.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // MATCHED_AT_ONCE))
    own = rows.repartition(tasks, *keys, "__apart").groupBy(*keys, "__apart")
    return own.agg(F.max("g").alias("g"), F.max(~F.col("g")).alias("p")).drop("__apart")


def span_counts(gold: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn over distinct spans, for each value of `by` (none: overall)."""
    keys = [*(by or []), *SPAN] if by and "document_id" not in by else SPAN
    both = matched(gold, predicted, keys)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    g, p = F.col("g"), F.col("p")
    return both.groupBy(*(by or [])).agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))


def with_prf(counts: DataFrame, empty: float = 1.0) -> DataFrame:
    """precision, recall, f1; an empty denominator counts as `empty` (1.0 or 0.0 by convention)."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_micro(counts: DataFrame, empty: float = 0.0) -> DataFrame:
    """Mean of the groups' scores with equal weight, and scores of the pooled counts."""
    each = with_prf(counts, empty).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).withColumn("average", F.lit("macro"))
    pooled = with_prf(counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), empty).withColumn("average", F.lit("micro"))
    cols = ["average", "precision", "recall", "f1"]
    return each.select(*cols).unionByName(pooled.select(*cols))


def report(gold: DataFrame, predicted: DataFrame, levels: list[list[str]], empty: float = 1.0) -> DataFrame:
    """Span scores at several levels at once, such as [["corpus", "document_id"], ["corpus"], []].

    Gold and predicted spans are matched once; the levels are grouping sets over the matches.
    A column that a level sums over is null there, and `level` numbers the levels as given.
    """
    names = list(dict.fromkeys(c for level in levels for c in level))
    keys = list(dict.fromkeys([*names, *SPAN]))
    both = matched(gold, predicted, keys)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    g, p = F.col("g"), F.col("p")
    counts = both.groupingSets([[F.col(c) for c in level] for level in levels], *names).agg(
        F.grouping_id().alias("__id"), count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn")
    )
    ids = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in level): k for k, level in enumerate(levels)}
    level = F.coalesce(*[F.when(F.col("__id") == i, F.lit(k)) for i, k in ids.items()]).alias("level")
    return with_prf(counts.select(level, *names, "tp", "fp", "fn"), empty)


def language_report(gold: DataFrame, predicted: DataFrame, sentences: DataFrame, languages: list[str]) -> DataFrame:
    """A row for each language asked for, also for those without data.

    sentences: (language, invalid, seconds), a row each: invalid outputs count as false
    positives, seconds are those of the model, null where its first call was warming up.
    """
    own = F.col("language").isin(languages)
    spans = span_counts(gold.where(own), predicted.where(own), ["language"])
    runs = sentences.where(own).groupBy("language").agg(
        F.count("*").alias("sentences"), F.count_if("invalid").alias("invalid"), F.count("seconds").alias("timed"), F.sum("seconds").alias("seconds")
    )
    asked = gold.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(languages)], "language string")
    rows = asked.join(spans, "language", "left").join(runs, "language", "left").na.fill(0, ["tp", "fp", "fn", "sentences", "invalid", "timed"])
    speed = F.when(F.col("seconds") > 0, F.col("timed") / F.col("seconds")).alias("sentences_per_second")
    return with_invalid(rows).select("language", "sentences", "invalid", "tp", "fp", "fn", "precision", "recall", "f1", speed, (F.col("sentences") == 0).alias("missing"))


def resolution_accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of gold (span, identifier) pairs that are predicted; 1.0 without any."""
    keys = [*SPAN, "identifier"]
    both = matched(gold.where("identifier is not null"), predicted.where("identifier is not null"), keys)
    return both.agg(F.count_if("g").alias("n"), F.count_if(F.col("g") & F.col("p")).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n"), 1.0))


def distance_errors(gold: DataFrame, predicted: DataFrame, order: str | None = None) -> DataFrame:
    """Kilometres between gold and prediction per gold span; an unresolved one costs the most.

    Of repeated predictions of a span the last counts, by `order` if given.
    """
    g = gold.where("latitude is not null").select(*SPAN, "latitude", "longitude").dropDuplicates(SPAN)
    place = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    pick = F.max_by(place, F.col(order)) if order else F.max(place)
    p = predicted.where("latitude is not null").groupBy(*SPAN).agg(pick.alias("at"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("at.lat"), F.col("at.lon"))
    return g.join(p, SPAN, "left").select(*SPAN, F.coalesce(km, F.lit(WORST_KM)).alias("km"))


def distance_metrics(errors: DataFrame, within: float = 161.0, by: list[str] | None = None) -> DataFrame:
    log_share = F.log1p(F.least("km", F.lit(WORST_KM))) / F.log1p(F.lit(WORST_KM))
    return errors.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg((F.col("km") <= within).cast("double")).alias("accuracy"),
        F.avg("km").alias("mean_km"),
        F.median("km").alias("median_km"),
        F.avg(log_share).alias("auc"),
    )


def with_invalid(counts: DataFrame) -> DataFrame:
    """Scores in which each invalid output counts as one false positive."""
    return with_prf(counts.withColumn("fp", F.col("fp") + F.col("invalid")))


def protocol_metrics(counts: DataFrame) -> DataFrame:
    """Ratios over summed resolution counts; 0 where nothing was eligible."""
    r = lambda a, b, name: ratio(F.col(a), F.col(b), 0.0).alias(name)
    return counts.select(
        "*",
        r("exact_correct", "exact_eligible", "exact_accuracy"),
        *[r(f"within_{k}_km", "coordinate_eligible", f"accuracy_{k}_km") for k in (1, 10, 50)],
        r("resolved", "gold", "coverage"),
        r("abstained", "gold", "abstention"),
        r("invalid", "gold", "invalid_rate"),
        r("candidate_found", "candidate_eligible", "candidate_recall"),
    )


def broken_counts(counts: DataFrame) -> DataFrame:
    """Rows of resolution counts that contradict themselves."""
    ok = (F.col("gold") == F.col("resolved") + F.col("abstained") + F.col("invalid")) & (F.col("exact_correct") <= F.col("exact_eligible"))
    ok = ok & (F.col("within_1_km") <= F.col("within_10_km")) & (F.col("within_10_km") <= F.col("within_50_km")) & (F.col("within_50_km") <= F.col("coordinate_eligible")) & (F.col("candidate_found") <= F.col("candidate_eligible"))
    return counts.where(~ok)


#: kinds of documents, and draws, that one task of a bootstrap holds, about
BLOCK_KINDS, DRAWS_AT_ONCE = 4096, 64


def bootstrap(counts: DataFrame, draws: int = 1000, seed: int = 0, stratum: str | None = None, pipeline: str | None = None, block_kinds: int = BLOCK_KINDS) -> DataFrame:
    """f1 of pooled tp, fp, fn over documents drawn with replacement: a row per draw.

    A draw takes as many documents as there are, in each stratum on its own.  Documents of
    equal counts are of one kind and drawn together, so the work grows with the kinds and
    not with the documents.  A multinomial number splits: how many documents each block of
    kinds gets is drawn first, and what each kind gets of them in a task for the block.  So
    neither draws nor kinds come together in one task, with strata or without.  The random
    state is a function of seed, stratum, block and draw.  With `pipeline`, counts have a
    row per document and pipeline; a draw takes the same documents for all pipelines, which
    must have the same documents.
    """
    own_stratum = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")) if stratum else F.lit("")
    rows = counts.select(
        own_stratum.alias("stratum"),
        F.col(pipeline).cast("string").alias("pipeline") if pipeline else F.lit("").alias("pipeline"),
        "document_id", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")],
    )
    if pipeline:
        sizes = rows.groupBy("stratum", "document_id").agg(F.count_distinct("pipeline").alias("p"), F.count("*").alias("c")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("c").alias("c")).first()
        if sizes["lo"] != sizes["hi"] or sizes["c"] != sizes["hi"]:
            raise ValueError("pipelines do not share their documents and strata")
    if pipeline:
        own = rows.groupBy("stratum", "document_id").agg(F.array_sort(F.collect_list(F.struct("pipeline", "tp", "fp", "fn"))).alias("all"))
    else:  # sums need neither lists nor a sort
        sums = rows.groupBy("stratum", "document_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        own = sums.select("stratum", "document_id", F.array(F.struct(F.lit("").alias("pipeline"), "tp", "fp", "fn")).alias("all"))
    kinds = own.groupBy("stratum", "all").agg(F.count("*").alias("n"))
    sizes = kinds.groupBy("stratum").agg(F.ceil(F.count("*") / block_kinds).cast("int").alias("blocks"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_AT_ONCE) - 1))).alias("chunk")
    dealt = written(kinds.join(sizes, "stratum").withColumn("block", F.pmod(F.xxhash64("all"), "blocks").cast("int")).drop("blocks"))

    def times_of(state: list, n: np.ndarray, documents: int) -> np.ndarray:
        return np.random.default_rng(state).multinomial(documents, n / n.sum())

    def among_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        n, state = pdf["n"].to_numpy(), [seed, zlib.crc32(key[0].encode()), 0]
        first = key[1] * DRAWS_AT_ONCE
        out = [pd.DataFrame({"stratum": key[0], "chunk": key[1], "block": pdf["block"], "draw": d, "documents": times_of([*state, d], n, n.sum())}) for d in range(first, min(draws, first + DRAWS_AT_ONCE))]
        return pd.concat(out)

    def among_kinds(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        all_of = [[(r["pipeline"], r["tp"], r["fp"], r["fn"]) for r in a] for a in held["all"]]
        order = sorted(range(len(all_of)), key=lambda i: all_of[i])
        n, state = held["n"].to_numpy()[order], [seed, zlib.crc32(key[0].encode()), key[2] + 1]
        names = sorted({r[0] for k in all_of for r in k})
        # sums of each kind by pipeline
        table = np.zeros((len(order), len(names), 3))
        for i, k in enumerate(order):
            for name, *values in all_of[k]:
                table[i, names.index(name)] += values
        out = []
        for d, documents in zip(asked["draw"], asked["documents"], strict=True):
            for name, sums in zip(names, np.tensordot(times_of([*state, d], n, documents), table, axes=1), strict=True):
                out.append((d, name, *map(int, sums)))
        return pd.DataFrame(out, columns=["draw", "pipeline", "tp", "fp", "fn"])

    blocks = dealt.groupBy("stratum", "block").agg(F.sum("n").alias("n")).select("*", chunk)
    asked = blocks.groupBy("stratum", "chunk").applyInPandas(among_blocks, "stratum string, chunk int, block int, draw int, documents long")
    key = ("stratum", "chunk", "block")
    held = dealt.select("*", chunk)
    drawn = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(among_kinds, "draw int, pipeline string, tp long, fp long, fn long")
    pooled = with_prf(drawn.groupBy("draw", "pipeline").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    return pooled if pipeline else pooled.drop("pipeline")


def interval(draws: DataFrame, value: str = "f1", share: float = 0.95) -> DataFrame:
    """Percentile interval by the inverse distribution function."""
    tail = (1 - share) / 2
    rows = draws.select(value, F.row_number().over(Window.orderBy(value)).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
    return rows.agg(F.max(F.when(F.col("r") == at(tail), F.col(value))).alias("low"), F.max(F.when(F.col("r") == at(1 - tail), F.col(value))).alias("high"))


def score_languages(gold: DataFrame, predicted: DataFrame, languages: list[str], language: str = "language") -> tuple[DataFrame, list[str]]:
    """Span counts and ratios of each language, and the languages of the list without gold."""
    own = F.col(language).isin(languages)
    counts = with_prf(span_counts(gold.where(own), predicted.where(own), [language]))
    found = {r[language] for r in gold.where(own).select(language).distinct().collect()}
    return counts, missing_languages(languages, found)


def missing_languages(wanted: list[str], found) -> list[str]:
    """Languages that were asked for and are not there, in the order in which they were asked for."""
    have = set(found)
    return [x for x in dict.fromkeys(wanted) if x not in have]


def paired_difference(draws: DataFrame, pipeline: str = "pipeline", value: str = "f1") -> DataFrame:
    """Draw by draw differences of pipelines, each pair once."""
    a = draws.select(F.col(pipeline).alias("first"), "draw", F.col(value).alias("a"))
    b = draws.select(F.col(pipeline).alias("second"), "draw", F.col(value).alias("b"))
    return a.join(b, "draw").where(F.col("first") < F.col("second")).select("first", "second", "draw", (F.col("a") - F.col("b")).alias("difference"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest complete run with a metric of each corpus and pipeline."""
    order = Window.partitionBy("corpus", "pipeline").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    full = runs.where("complete and metric is not null")
    return full.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def regressions(base: DataFrame, new: DataFrame, most: float = 1.25) -> DataFrame:
    """Benchmarks whose seconds grew beyond the gate: the median over runs of each run's median.

    Without a column `run` all rows are one run.
    """
    def one(df: DataFrame, name: str) -> DataFrame:
        run = F.col("run") if "run" in df.columns else F.lit(0)
        own = df.groupBy("benchmark", run.alias("run")).agg(F.median("seconds").alias("m"))
        return own.groupBy("benchmark").agg(F.median("m").alias(name))

    return one(base, "base").join(one(new, "new"), "benchmark").withColumn("failed", F.col("new") > most * F.col("base"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").count()
