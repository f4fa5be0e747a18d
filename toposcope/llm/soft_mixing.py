"""Mixing to target weights by soft domain membership, in DataFrame operations only.

A classifier fitted on labelled rows gives each text posteriors over domains.  The
expected tokens of text i in the domains are the vector a_i = tokens_i * p_i.
Nonnegative rates r_i (1 at first) are fitted so that sum(r_i * a_i) meets the targets, by
projected gradient steps on the least squares |A r - target|^2:

    gap = A r - target;   r_i = max(0, r_i - p_i . (G^-1 gap)),   G = sum(n_i p_i p_i')

Here texts are measured by 1 / tokens_i and gaps by the inverse of the Gram matrix G, in
which a full step descends: without the bound at 0 the first one would meet the targets.
Where these steps stall (targets that cannot all be met), steps on the plain squared gap
follow, r_i = max(0, r_i - (p_i . gap) / (p_i . A1)), whose length is the bound by row
sums of A'A.  Momentum shortens the way.  Each step is one distributed sum of a few
numbers for each domain.  A text's rate follows from the steps and its own posteriors, so
rates need not be joined back to texts.

The classifier has two steps, both fitted on at most `sample_texts` labelled texts (least
hash of id).  Hashed words whose share of texts differs between a domain and the others
by more than SURE standard errors get log ratios, shrunk to the pooled share; a text has
their sum and their largest for each domain, and four figures of its shape.  A softmax
regression on these gives the posteriors.  Its inputs on the sample come from word tables
that leave out the text's own fold, so the posteriors are calibrated for unseen texts.
Only tables of bounded size come to the driver: words that tell domains apart (at most
BUCKETS), and the inputs of the sample.

Steps end when the totals miss the targets by less than `close` of all tokens, or when it
is proven that they cannot be met: from a gap g with p_i . g >= -e for all texts, no
rates come closer to the target than -(g + e) . target / |g + e|.  The share of tokens
that is missed is returned in the column `miss`.

Defined results: a null or empty text has no tokens, the prior as posterior and rate 1;
repeated rows get equal posteriors and rates, and count once in the sample (of rows that
clash on a doc_id, the least text); without labelled texts, or with an empty table, every
rate is 1 and miss is null; columns named like a result are replaced, others are kept.
The rate is the decision: no row is dropped or repeated here, `copies` says how often a
sampler takes the row.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.llm._shared import scratch, stash, table

BUCKETS = 1 << 16
BREAKS, SPACES = r"[\x09-\x0D\x20]+", "\t\n\x0b\x0c\r "
PUNCTUATION = ".,;:!?()\"'"
FOLDS = 3
SURE = 4.0
#: texts of the pooled share that a domain's share is shrunk by
SHRINK = 20
TARGETS = {"q1t0": 0.85, "q0t0": 0.13, "q1t1": 0.01, "q0t1": 0.01}
RESULTS = ("n_tokens", "domain", "posteriors", "rate", "copies", "miss")


def words(text: Column) -> Column:
    own = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, BREAKS))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.btrim(F.lower(word), F.lit(PUNCTUATION))), F.lit(BUCKETS)).cast("int")


def _numbers(values, kind: str = "double") -> Column:
    """An array literal: folded when the plan is optimised."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of each labelled document."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))).alias("domain"))


class Domains:
    """Names of the domains, word weights by bucket, and the softmax regression.

    report has the log loss and accuracy on texts of the sample that neither the word
    table nor the regression had seen, and the same of the constant shares.
    """

    def __init__(self, names: list[str], weights: dict[int, list[float]], center: np.ndarray, slopes: np.ndarray, report: dict[str, float]):
        self.names, self.weights, self.center, self.slopes, self.report = names, weights, center, slopes, report


def _tokens(documents: DataFrame) -> DataFrame:
    """documents plus their words and the distinct hashed words."""
    docs = documents.withColumn("__words", words(F.col("text")))
    return docs.withColumn("__at", F.array_distinct(F.transform(F.array_distinct("__words"), _bucket)))


def _looked_up(places: str, values: Column) -> Column:
    return F.transform(places, lambda i: F.get(values, i))


def _with_inputs(tokens: DataFrame, weights: dict[int, list[float]], domains: int) -> DataFrame:
    """tokens plus what the regression reads, __x, by way of the places of telling words."""
    place = np.zeros(BUCKETS, dtype=int)
    rows = sorted(weights)
    place[rows] = np.arange(1, len(rows) + 1)
    told = tokens.withColumn("__told", F.filter(_looked_up("__at", _numbers(place.tolist(), "int")), lambda i: i > 0))
    got = [f"__got{d}" for d in range(domains)]
    told = told.withColumns({c: _looked_up("__told", _numbers([0.0, *(float(weights[b][d]) for b in rows)])) for d, c in enumerate(got)})
    out = []
    for c in got:
        total = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
        out += [F.greatest(F.lit(-20.0), F.least(F.lit(20.0), total)), F.greatest(F.lit(0.0), F.coalesce(F.array_max(c), F.lit(0.0)))]
    n = F.size("__words").cast("double")
    per = F.greatest(n, F.lit(1.0))
    capital = F.size(F.filter("__words", lambda w: (w >= "A") & (w < "[")))  # words are compared by bytes
    out += [F.log1p(n), F.size("__at") / per, F.length(F.coalesce("text", F.lit(""))) / per, capital / per]
    return told.withColumn("__x", F.array(*out)).drop("__told", *got)


def _softmax(x: np.ndarray, center: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    z = np.hstack([(x - center[0]) / center[1], np.ones((len(x), 1))]) @ slopes
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_softmax(x: np.ndarray, y: np.ndarray, domains: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression under a fixed bound of its curvature, which always descends."""
    center = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-9])
    a = np.hstack([(x - center[0]) / center[1], np.ones((len(x), 1))])
    step = np.linalg.inv(a.T @ a / 2 + ridge * np.eye(a.shape[1]))
    slopes, own = np.zeros((a.shape[1], domains)), np.eye(domains)[y]
    for _ in range(rounds):
        slopes -= step @ (a.T @ (_softmax(x, center, slopes) - own) + ridge * slopes)
    return center, slopes


def _telling(sample: DataFrame, names: list[str], sizes: np.ndarray) -> list[dict[int, list[float]]]:
    """Word weights without each fold, and with all: the log ratios that are sure.

    sizes: texts by fold and domain.
    """
    hashed = _tokens(sample).select("domain", "fold", F.explode("__at").alias("bucket"))
    seen = hashed.groupBy("bucket").agg(*[F.count_if((F.col("domain") == name) & (F.col("fold") != m)).alias(f"s{m}_{c}") for m in range(FOLDS + 1) for c, name in enumerate(names)])
    models = []
    for m in range(FOLDS + 1):
        n = np.delete(sizes, m, axis=0).sum(axis=0) if m < FOLDS else sizes.sum(axis=0)
        total = sum((F.col(f"s{m}_{c}") for c in range(len(names))), F.lit(0))
        logs = []
        for c in range(len(names)):
            own, rest = float(n[c]), float(n.sum() - n[c])
            s = F.col(f"s{m}_{c}")
            p = (total - s + 0.5) / (rest + 1)
            q = (s + SHRINK * p) / (own + SHRINK)
            error = F.sqrt(own * p * (1 - p) + own * own * p * (1 - p) / (rest + 1) + 0.5)
            logs.append(F.when(F.abs(s - own * p) > SURE * error, F.log(q / p)).otherwise(0.0))
        models.append(F.array(*logs))
    told = seen.select("bucket", F.array(*models).alias("w")).where(F.exists("w", lambda m: F.exists(m, lambda x: x != 0)))
    # at most BUCKETS rows come back
    out: list[dict[int, list[float]]] = [{} for _ in models]
    for r in told.collect():
        for m, own in enumerate(r["w"]):
            if any(own):
                out[m][r["bucket"]] = list(own)
    return out


def fit_domains(documents: DataFrame, labels: DataFrame, sample_texts: int = 20_000, path: str | None = None) -> Domains | None:
    spark = documents.sparkSession
    path = path or scratch(spark)
    chosen = stash(domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_texts), f"{path}/domains")
    # at most sample_texts rows are broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min("text").alias("text"))
    sample = stash(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int")), f"{path}/sample")
    counted = {(r["domain"], r["fold"]): r["count"] for r in sample.groupBy("domain", "fold").count().collect()}
    if not counted:
        return None
    names = sorted({d for d, _ in counted})
    sizes = np.array([[counted.get((d, f), 0) for d in names] for f in range(FOLDS)], dtype=float)
    weights = _telling(sample, names, sizes)
    tokens = _tokens(sample)
    x, y, folds = [], [], []
    for f in range(FOLDS):
        # at most sample_texts rows of a few numbers
        for r in _with_inputs(tokens.where(F.col("fold") == f), weights[f], len(names)).select("domain", "__x").collect():
            x.append(r["__x"])
            y.append(names.index(r["domain"]))
            folds.append(f)
    x, y, folds = np.array(x), np.array(y), np.array(folds)
    order = np.lexsort((*x.T, y, folds))
    x, y, folds = x[order], y[order], folds[order]
    p = np.zeros((len(y), len(names)))
    for f in np.unique(folds):
        rest = folds != f
        p[~rest] = _softmax(x[~rest], *_fit_softmax(x[rest], y[rest], len(names))) if rest.any() else 1 / len(names)
    share = sizes.sum(axis=0) / sizes.sum()
    at = np.arange(len(y))
    report = {"texts": len(y), "log_loss": float(-np.log(np.maximum(p[at, y], 1e-12)).mean()), "accuracy": float((p.argmax(axis=1) == y).mean()), "constant_log_loss": float(-np.log(share[y]).mean()), "constant_accuracy": float(share.max())}
    return Domains(names, weights[FOLDS], *_fit_softmax(x, y, len(names)), report)


def with_posteriors(documents: DataFrame, domains: Domains) -> DataFrame:
    """documents plus n_tokens and an array `posteriors` in the order of the names."""
    docs = _with_inputs(_tokens(documents), domains.weights, len(domains.names))
    slopes = domains.slopes[:-1] / domains.center[1][:, None]
    constant = domains.slopes[-1] - domains.center[0] @ slopes
    # one list of slopes for each domain, the constant last
    known = F.from_json(F.lit(json.dumps(np.vstack([slopes, constant]).T.tolist())), "array<array<double>>")
    inputs = F.concat("__x", F.array(F.lit(1.0)))
    logits = F.transform(known, lambda own: F.aggregate(F.zip_with(inputs, own, lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v))
    top = F.array_max("__z")
    out = docs.withColumn("n_tokens", F.size("__words").cast("long")).drop("__words", "__at")
    out = out.withColumn("__z", logits).withColumn("__e", F.transform("__z", lambda z: F.exp(z - top)))
    total = F.aggregate("__e", F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn("posteriors", F.transform("__e", lambda x: x / total)).drop("__x", "__z", "__e")


def _dot(values: Column, domains: int) -> Column:
    return sum((F.get("posteriors", F.lit(d)) * F.get(values, F.lit(d)) for d in range(domains)), F.lit(0.0))


def _step(state: Column, gap: Column, momentum: Column, size: Column, domains: int) -> Column:
    """(r, y) after one step from y, where the gap was measured."""
    r = F.greatest(F.lit(0.0), state["y"] - F.coalesce(F.try_divide(_dot(gap, domains), size), F.lit(0.0)))
    # r is worked out once, as the element of an array
    return F.get(F.transform(F.array(r), lambda r: F.struct(r.alias("r"), (r + momentum * (r - state["r"])).alias("y"))), F.lit(0))


def nearest(gap: np.ndarray, least: float, target: np.ndarray) -> float:
    """No nonnegative rates come closer to the target; least: the smallest p_i . gap."""
    g = gap + max(0.0, -least)
    size = np.linalg.norm(g)
    return max(0.0, float(-(g @ target) / size)) if size else 0.0


Steps = list[tuple[list[float], float, list[float]]]


def fit_rates(scored: DataFrame, target: np.ndarray, path: str, most_steps: int = 100, close: float = 1e-3) -> tuple[Steps, int, float]:
    """Steps (direction, momentum, scale), the number of domains, and the share missed.

    The two numbers that a text carries are written out at each step.  It ends when the
    gap is small, when it is proven to be within a hundredth of the least possible, or
    after most_steps.
    """
    d = len(target)
    mass = [F.col("n_tokens") * F.get("posteriors", F.lit(i)) for i in range(d)]

    def totals(df: DataFrame, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        least = F.min(F.when(F.col("n_tokens") > 0, _dot(_numbers(gap.tolist()), d)))
        got = df.agg(*[F.sum(F.col(f"state.{v}") * m).alias(f"{v}{i}") for v in "ry" for i, m in enumerate(mass)], least.alias("least")).first()
        return *(np.array([got[f"{v}{i}"] or 0.0 for i in range(d)]) for v in "ry"), got["least"] or 0.0

    cells = scored.agg(*[F.sum(mass[i] * F.get("posteriors", F.lit(j))).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    gram = np.array([[cells[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    whole = gram.sum(axis=1)  # posteriors sum to 1
    inverse = np.linalg.inv(gram + 1e-9 * max(np.trace(gram), 1.0) * np.eye(d))
    state = scored.withColumn("state", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")))
    steps, t, bound, scale = [], 1.0, 0.0, max(target.sum(), 1.0)
    now = ahead = whole
    misses, plain = [np.abs(now - target).sum() / scale], False
    while len(steps) < most_steps and misses[-1] > close and bound < 0.99 * np.linalg.norm(now - target):
        if not plain and len(misses) > 4 and misses[-1] > 0.9 * misses[-4]:
            plain, t, ahead = True, 1.0, now
            state = state.withColumn("state", F.struct(F.col("state.r").alias("r"), F.col("state.r").alias("y")))
            steps[-1] = (steps[-1][0], 0.0, steps[-1][2])
        elif len(misses) > 1 and misses[-1] > misses[-2]:
            t = 1.0  # momentum starts anew when it overshoots
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        gap, momentum, before = ahead - target, (t - 1) / after, now - target
        step = (gap if plain else inverse @ gap).tolist(), momentum, whole.tolist() if plain else [1.0] * d
        steps.append(step)
        new = _step(F.col("state"), _numbers(step[0]), F.get(_numbers([momentum]), F.lit(0)), _dot(_numbers(step[2]), d), d)
        state = stash(state.withColumn("state", new), f"{path}/state{len(steps)}")
        now, ahead, least = totals(state, before)
        bound, t = max(bound, nearest(before, least, target)), after
        misses.append(np.abs(now - target).sum() / scale)
    return steps, d, float(misses[-1])


def _rate(steps: Steps, domains: int) -> Column:
    """The rate of a text after all steps, from its posteriors alone."""
    known = F.from_json(F.lit(json.dumps([{"g": g, "m": m, "s": s} for g, m, s in steps])), "array<struct<g:array<double>,m:double,s:array<double>>>")
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    return F.aggregate(known, start, lambda acc, s: _step(acc, s["g"], s["m"], _dot(s["s"], domains), domains))["r"]


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total_tokens: float | None = None, path: str | None = None, carry: tuple[str, ...] | None = None) -> DataFrame:
    """documents plus n_tokens, domain (the likeliest), posteriors, rate, copies and miss.

    targets: shares of the domains, normalised over those that occur in the labels;
    total_tokens: tokens after mixing, by default as many as before; carry: columns of the
    documents in the result, by default all (what it leaves out is not written).  copies is the rate
    rounded up or down by a hash of the id, so its expectation is the rate; miss: the share
    of all tokens by which the expected domain totals miss the targets, the same in each row.
    """
    spark = documents.sparkSession
    path = path or scratch(spark)
    docs = documents.drop(*RESULTS)
    kept = [c for c in docs.columns if carry is None or c in carry or c == "doc_id"]
    domains = fit_domains(docs, labels, path=path)
    unit = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    if domains is None:
        out = docs.withColumn("n_tokens", F.size(words(F.col("text"))).cast("long")).withColumn("domain", F.lit(None).cast("string")).withColumn("posteriors", F.array().cast("array<double>"))
        out = out.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "domain", "posteriors")
        return out.withColumn("rate", F.lit(1.0)).withColumn("copies", F.lit(1).cast("long")).withColumn("miss", F.lit(None).cast("double"))
    scored = with_posteriors(docs, domains).select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "posteriors")
    scored = stash(scored, f"{path}/scored")
    slim = scored.select("n_tokens", "posteriors")
    if total_tokens is None:
        total_tokens = float(slim.agg(F.sum("n_tokens")).first()[0] or 0)
    share = np.array([targets.get(d, 0.0) for d in domains.names])
    share = share / share.sum() if share.sum() else np.full(len(share), 1 / len(share))
    steps, d, miss = fit_rates(slim, share * total_tokens, f"{path}/rates")
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int") - 1
    out = scored.withColumn("domain", F.get(F.array(*map(F.lit, domains.names)), best)).withColumn("rate", _rate(steps, d)).withColumn("miss", F.lit(miss))
    return out.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, table(spark, sf_dir, "labels"), carry=("doc_id",))
    return mixed.select("doc_id", *RESULTS)
