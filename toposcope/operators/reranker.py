"""A reranker that is trained on pairs of a context and a candidate's description.

The score of a pair is linear in a few features, all native column expressions.  The
weights are those of a ridge regression on the labels; its normal equations are sums over
all pairs, made in one aggregation, so pairs are never gathered.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("one", "words_shared", "words_covered", "level_named", "type_named", "length", "similarity")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def pair_features(context: Column, description: Column, similarity: Column | None = None) -> list[Column]:
    """A number for each of FEATURES.  A description reads `name (type) in level, level`."""
    c, d = _words(context), _words(description)
    both = F.size(F.array_intersect(c, d)).cast("double")
    share = lambda over, under: F.when(under > 0, over / under).otherwise(0.0)
    named = lambda part: share(F.size(F.array_intersect(c, _words(part))).cast("double"), F.size(_words(part)))
    return [
        F.lit(1.0),
        share(both, F.size(F.array_union(c, d))),
        share(both, F.size(d)),
        named(F.regexp_extract(F.coalesce(description, F.lit("")), r" in (.*)$", 1)),
        named(F.regexp_extract(F.coalesce(description, F.lit("")), r"\(([^)]*)\)", 1)),
        F.log1p(F.length(F.coalesce(description, F.lit(""))).cast("double")) / 10,
        F.coalesce(similarity.cast("double"), F.lit(0.0)) if similarity is not None else F.lit(0.0),
    ]


class PairReranker:
    """fit() learns from pairs (context, description, label and, if there, similarity)."""

    def __init__(self, weights: list[float] | None = None):
        self.weights = weights

    def fit(self, pairs: DataFrame, ridge: float = 1e-3) -> PairReranker:
        x = pair_features(F.col("context"), F.col("description"), F.col("similarity") if "similarity" in pairs.columns else None)
        rows = pairs.select(F.array(*x).alias("x"), F.col("label").cast("double").alias("y")).where("y is not null")
        k = len(FEATURES)
        # positive pairs weigh as much as negative ones in all, however few they are
        n = rows.agg(F.count_if(F.col("y") > 0).alias("yes"), F.count_if(F.col("y") <= 0).alias("no")).first()
        if not n["yes"] or not n["no"]:
            raise ValueError("training pairs need both labels")
        weight = F.when(F.col("y") > 0, 0.5 / n["yes"]).otherwise(0.5 / n["no"])
        at = lambda i: F.col("x")[i]
        sums = [F.sum(weight * at(i) * at(j)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(weight * at(i) * F.col("y")).alias(f"r{i}") for i in range(k)]
        r = rows.agg(*sums).first()
        gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        right = np.array([r[f"r{i}"] for i in range(k)])
        self.weights = np.linalg.solve(gram + ridge * np.eye(k), right).tolist()
        return self

    def score(self, context: Column, description: Column, similarity: Column | None = None) -> Column:
        if self.weights is None:
            raise ValueError("fit() comes first")
        out = F.lit(0.0)
        for w, x in zip(self.weights, pair_features(context, description, similarity), strict=True):
            out = out + F.lit(float(w)) * x
        return out

    def __call__(self, rows: DataFrame) -> DataFrame:
        """A shortlist (context, description, similarity) with its score, for `resolve.tiered`."""
        return rows.withColumn("score", self.score(F.col("context"), F.col("description"), F.col("similarity")))

    def to_json(self) -> str:
        return json.dumps(dict(zip(FEATURES, self.weights, strict=True)))

    @classmethod
    def from_json(cls, text: str) -> PairReranker:
        held = json.loads(text)
        return cls([held[f] for f in FEATURES])
