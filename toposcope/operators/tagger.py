"""A recognizer that is trained: an averaged perceptron tagger, fitted by iterative parameter mixing.

Tokens are tagged from left to right as outside, beginning or inside of a name, by weights of
hashed features (the word, its shape, ends and neighbours, the tag before).  In each epoch
every partition runs a perceptron over its own documents, beginning with the mixed weights
of the epoch before, and passes on what its averaged weights have moved by; the moves are summed by
weight and divided by the partitions that had documents.  What a task and the driver hold
is bounded by the number of weights, whatever the corpus.

Documents with null spans are unknown and not learnt from; with null texts they get null
spans.  A span takes the tokens that lie in it, so spans that cut through words take none of those.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.operators.recognize import SPAN_LIST
from toposcope.operators.scratch import written

OUTSIDE, BEGIN, INSIDE = range(3)
BITS = 18
#: what lies between tokens, and the tokens
_PARTS = re.compile(r"(\w+|[^\w\s])")
_REPEATED = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})


def _shape(word: str) -> str:
    """Kinds of characters, repeated ones once."""
    if word.isascii() and word.isalpha():
        if word.islower():
            return "x"
        if word[1:].islower():
            return "Xx"
    return _REPEATED.sub(r"\1", ("X" + word[1:] if word[:1].isupper() else word).translate(_SHAPE))


@lru_cache(maxsize=1 << 16)
def _about(word: str) -> tuple[str, ...]:
    """Features of a word by itself."""
    low = word.lower()
    return (f"w={low}", f"s={_shape(word)}", f"p={low[:3]}", f"e={low[-3:]}", f"f={low[-2:]}")


@lru_cache(maxsize=1 << 18)
def _place(feature: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(feature) >> (32 - bits)


def _features(words: list[str], i: int, bits: int) -> list[int]:
    before, after = (words[i - 1] if i else "<"), (words[i + 1] if i + 1 < len(words) else ">")
    own = _about(words[i])
    return [_place(f, bits) for f in ("b", *own, f"a={before.lower()}", f"n={after.lower()}", f"as={_about(before)[1]}", f"ns={_about(after)[1]}", f"aw={before.lower()} {own[0]}")]


def _split(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of a text, where they begin and where they end."""
    parts = _PARTS.split(text)
    at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return parts[1::2], at[:-1:2], at[1::2]


def _tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    words, starts, ends = _split(text)
    return words, list(zip(starts.tolist(), ends.tolist(), strict=True))


def _gold(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tags of tokens; of spans that share tokens the last one, by start and end, counts."""
    tags = np.zeros(len(starts), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    low, high = np.searchsorted(starts, spans[:, 0]), np.searchsorted(ends, spans[:, 1], side="right")
    low, high = low[high > low], high[high > low]
    if (low[1:] >= high[:-1]).all():
        edges = np.zeros(len(starts) + 1, np.int64)
        edges[low] += 1
        edges[high] -= 1
        tags[np.cumsum(edges[:-1]) > 0] = INSIDE
        tags[low] = BEGIN
        return tags
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        tags[a], tags[a + 1 : b] = BEGIN, INSIDE
    return tags


def _pairs(spans) -> np.ndarray:
    return np.asarray(spans, np.int64).reshape(-1, 2)


def gold_tags(places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    own = _pairs(places)
    return _gold(own[:, 0], own[:, 1], _pairs(spans)).tolist()


def _runs(tags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last tokens of spans; first: where texts begin.  An inside tag without a beginning begins a span."""
    before = np.roll(tags, 1)
    before[first] = OUTSIDE
    after = np.roll(tags, -1)
    after[first - 1] = OUTSIDE
    return np.flatnonzero((tags == BEGIN) | (tags == INSIDE) & (before == OUTSIDE)), np.flatnonzero((tags != OUTSIDE) & (after != INSIDE))


def tagged_spans(places: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int]]:
    low, high = _runs(np.asarray(tags, np.int64), np.zeros(min(1, len(tags)), np.int64))
    return [(places[a][0], places[b][1]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]


class _Known(dict):
    """feature -> place, of features that many words have."""

    def __init__(self, bits: int):
        self.bits = bits

    def __missing__(self, feature: str) -> int:
        self[feature] = out = xxhash.xxh32_intdigest(feature) >> (32 - self.bits)
        return out


class _Words(dict):
    """word -> row of `places`: its own features, then those that it gives to its neighbours.

    Rows are remembered up to a bound, past which `fresh` forgets them.
    """

    LIMIT = 1 << 18

    def __init__(self, bits: int):
        self.bits = bits
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.known, self.pairs, self.rows, self.places = _Known(self.bits), ([], []), array("i"), np.zeros((0, 9), np.int32)

    def __missing__(self, word: str) -> int:
        digest, cut, known, low, shape = xxhash.xxh32_intdigest, 32 - self.bits, self.known, word.lower(), _shape(word)
        after = f" w={low}"
        self.rows.extend((
            digest(after[1:]) >> cut, known[f"s={shape}"], known[f"p={low[:3]}"], known[f"e={low[-3:]}"], known[f"f={low[-2:]}"],
            digest(f"a={low}") >> cut, digest(f"n={low}") >> cut, known[f"as=s={shape}"], known[f"ns=s={shape}"],
        ))
        befores, afters = self.pairs
        befores.append(f"aw={low}".encode())
        afters.append(after.encode())
        self[word] = n = len(self)
        return n

    def features(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """What _features gives, a column for each token; first: where texts begin."""
        if len(self) > self.LIMIT:
            self.fresh()
        start, end, own = self["<"], self[">"], np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.rows:
            self.places = np.concatenate([self.places, np.frombuffer(self.rows, np.int32).reshape(-1, 9)])
            self.rows = array("i")
        before, after = np.roll(own, 1), np.roll(own, -1)
        before[first] = start
        after[first - 1] = end
        out = np.empty((11, len(own)), np.int64)
        out[0] = self.known["b"]
        out[1:6] = self.places[own, :5].T
        for i, (at, of) in enumerate(((before, 5), (after, 6), (before, 7), (after, 8)), 6):
            out[i] = self.places[at, of]
        both = (map(part.__getitem__, at.tolist()) for part, at in zip(self.pairs, (before, own), strict=True))
        out[10] = np.fromiter(map(xxhash.xxh32_intdigest, map(add, *both)), np.int64, len(own)) >> (32 - self.bits)
        return out


#: tokens of the texts that are looked at together, about
BLOCK = 1 << 16
#: the least and the most tokens that are tagged before it is seen if one of them is wrong
LEAST_AHEAD, MOST_AHEAD = 64, 4096


def _blocks(documents: Iterable[tuple], words: _Words) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (text, ...) in blocks: documents with the numbers of their tokens, features, starts, ends, where texts that have tokens begin."""
    own, tokens, starts, ends, n = [], [], [], [], 0

    def whole() -> tuple:
        sizes = np.array([k for _, k in own])
        at = np.cumsum(sizes) - sizes
        first = at[sizes > 0]
        return own, words.features(tokens, first) if tokens else np.zeros((11, 0), np.int64), np.concatenate(starts), np.concatenate(ends), first

    for document in documents:
        found, a, b = _split(document[0] or "")
        own.append((document, len(found)))
        tokens += found
        starts.append(a)
        ends.append(b)
        n += len(found) + 1
        if n >= BLOCK:
            yield whole()
            own, tokens, starts, ends, n = [], [], [], [], 0
    if own:
        yield whole()


def _summed(rows: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Scores of tokens by tag: rows are added one after another, as floating-point sums depend on their order."""
    out = rows.take(features[0], 0)
    for f in features[1:]:
        out += rows.take(f, 0)
    return out


def _best(scores: np.ndarray) -> np.ndarray:
    """The tag of the highest score, the first of equal ones."""
    out, beginning, inside = scores.T
    return np.where(inside > np.maximum(out, beginning), INSIDE, (beginning > out).astype(np.int64))


class Weights:
    """Weights of features by tag, and of tags by the tag before."""

    def __init__(self, bits: int = BITS, values: np.ndarray | None = None):
        self.bits = bits
        self.values = np.zeros(((1 << bits) + 3) * 3, np.float32) if values is None else values

    def tags(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tags of the tokens of texts, from left to right; first: where texts begin.

        Tokens are scored together for each tag that can stand before them.  Of most the tag
        is the same whatever stands there, and only the others are gone through.
        """
        rows = self.values.reshape(-1, 3)
        each, after = _summed(rows, features).astype(np.float64), rows[1 << self.bits :].astype(np.float64)
        best = np.stack([_best(each + after[before]) for before in (OUTSIDE, BEGIN, INSIDE)], 1)
        best[first] = best[first, :1]
        out = best[:, 0].tolist()
        open_ = np.flatnonzero((best != best[:, :1]).any(1))
        for i, own in zip(open_.tolist(), best[open_].tolist(), strict=True):
            out[i] = own[out[i - 1]]
        return np.array(out, np.int64)

    def tag(self, words: list[str]) -> list[int]:
        if not words:
            return []
        first = np.zeros(1, np.int64)
        return self.tags(_Words(self.bits).features(words, first), first).tolist()


def one_epoch(weights: Weights, documents: Iterable[tuple]) -> tuple[np.ndarray, int]:
    """The averaged weights of a perceptron that begins with the given ones, and the mistakes it made.

    Weights change at mistakes alone, so tokens are scored together up to the next one.
    """
    values, bits = weights.values.astype(np.float32), weights.bits
    late, one = np.zeros_like(values), np.float32(1)
    rows, words, step, mistakes, ahead = values.reshape(-1, 3), _Words(bits), 1, 0, LEAST_AHEAD
    for own, features, starts, ends, first in _blocks(documents, words):
        n, to = len(starts), np.cumsum([k for _, k in own])
        want = np.concatenate([_gold(starts[b - k : b], ends[b - k : b], _pairs(d[1])) for (d, k), b in zip(own, to.tolist(), strict=True)])
        before = np.roll(want, 1)
        before[first] = OUTSIDE
        features = np.concatenate([features, ((1 << bits) + before)[None]])
        at = 0
        while at < n:
            wrong = np.flatnonzero((got := _best(_summed(rows, features[:, at : at + ahead]))) != want[at : at + ahead])
            if not len(wrong):
                at, ahead = at + ahead, min(2 * ahead, MOST_AHEAD)
                continue
            gap = int(wrong[0])
            at, ahead, mistakes = at + gap, max(2 * gap, LEAST_AHEAD), mistakes + 1
            cells, now = features[:, at] * 3, np.float32(step + at)
            more, less = cells + want[at], cells + got[gap]
            np.add.at(values, more, one)
            np.subtract.at(values, less, one)
            np.add.at(late, more, now)
            np.subtract.at(late, less, now)
            at += 1
        step += n
    return values - late / step, mistakes


def _span_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """(start, end) of each row's spans."""
    at, own = column.offsets.to_numpy().tolist(), column.values
    both = np.stack([own.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end")], 1)
    return (both[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


#: texts, which may be long, that are handed to Python together
BATCH_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class PerceptronRecognizer:
    """fit() learns from documents (text, spans); called with documents (id, text) it gives (id, spans)."""

    def __init__(self, bits: int = BITS, weights: np.ndarray | None = None):
        self.bits, self.weights, self.mistakes = bits, weights, []

    def fit(self, documents: DataFrame, epochs: int = 5, partitions: int | None = None) -> PerceptronRecognizer:
        """partitions: in how many parts the documents are learnt from (as they are); documents are written once."""
        spark, bits = documents.sparkSession, self.bits
        _short_batches(spark)
        rows = documents.where("text is not null and spans is not null").select("text", "spans")
        data = written(rows.repartition(partitions) if partitions else rows)
        if data.isEmpty():
            raise ValueError("no annotated documents to learn from")
        mixed, self.mistakes = np.zeros(((1 << bits) + 3) * 3, np.float64), []
        for _ in range(epochs):
            shared = spark.sparkContext.broadcast(mixed.astype(np.float32))

            def moves(parts, shared=shared):
                texts = (d for batch in parts for d in zip(batch.column("text").to_pylist(), _span_arrays(batch.column("spans")), strict=True))
                first = next(texts, None)
                if first is None:
                    return
                start = shared.value
                values, wrong = one_epoch(Weights(bits, start), (x for part in ([first], texts) for x in part))
                at = np.flatnonzero(values != start)
                # place -1 counts the parts, place -2 the mistakes
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[(values - start)[at].astype(float), 1.0, wrong])], ["place", "move"])

            moved = data.mapInArrow(moves, "place long, move double").groupBy("place").agg(F.sum("move").alias("move")).toPandas()
            by = dict(zip(moved["place"], moved["move"], strict=True))
            self.mistakes.append(int(by.pop(-2)))
            parts = by.pop(-1)
            mixed[np.fromiter(by.keys(), np.int64, len(by))] += np.fromiter(by.values(), float, len(by)) / parts
            if not self.mistakes[-1]:
                break
        self.weights = mixed.astype(np.float32)
        return self

    def __call__(self, docs: DataFrame) -> DataFrame:
        if self.weights is None:
            raise ValueError("fit() comes first")
        shared, bits = docs.sparkSession.sparkContext.broadcast(self.weights), self.bits

        def run(parts):
            own, words = Weights(bits, shared.value), _Words(bits)
            for batch in parts:
                for docs_of, features, starts, ends, first in _blocks(zip(batch.column("text").to_pylist(), batch.column("id"), strict=True), words):
                    low, high = _runs(own.tags(features, first), first)
                    offsets = np.searchsorted(low, np.cumsum([0, *(k for _, k in docs_of)]))
                    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (starts[low], ends[high])], ["start", "end"])
                    unknown = pa.array([text is None for (text, _), _ in docs_of])
                    yield pa.RecordBatch.from_arrays([pa.array([i for (_, i), _ in docs_of], batch.column("id").type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans, mask=unknown)], ["id", "spans"])

        _short_batches(docs.sparkSession)
        return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("spans", SPAN_LIST)]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights that are not 0, as a table."""
        at = np.flatnonzero(self.weights)
        rows = pd.DataFrame({"bits": self.bits, "place": at, "weight": self.weights[at].astype(float)})
        spark.createDataFrame(rows, "bits int, place long, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PerceptronRecognizer:
        rows = spark.read.parquet(path).toPandas()
        bits = int(rows["bits"].iloc[0])
        weights = np.zeros(((1 << bits) + 3) * 3, np.float32)
        weights[rows["place"]] = rows["weight"]
        return cls(bits, weights)
