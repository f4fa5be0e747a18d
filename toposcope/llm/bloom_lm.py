"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a log scale; a filter holds the events
(n-gram, 1) .. (n-gram, level).  A count is read back by probing level after level until
one is missing.  A count between two levels is rounded up or down by a hash of its
n-gram, with the chances that keep its expectation, so sums of counts read back are
unbiased.  A pair's probability is smoothed with the word's own:

    p(v | u) = (c(u v) + strength * p(v)) / (c(u) + strength + false)
    p(v)     = (c(v) + 1) / (N + V + 1)

`false` is the count that the V known words are expected to get by false positives after
any u: V times the chance that all probes of an absent pair hit.  The number of probes is
chosen so that it is at most about FALSE_COUNT whatever V, so bits grow with log V.  Over the
known words and the unknown one the probabilities after a context sum to 1 up to chance.
Pairs of unknown words have no count, and after an unknown word p(v | u) = p(v).

Texts are read twice.  First, each task sends its n-grams, summed and packed as arrays,
to the segment of the key space that owns them; a segment sums them, keeps its exact word
counts and builds its own part of the filter.  At most COMMON of the most frequent words
are broadcast with their exact counts; the filter holds the other words, and all pairs.
Then tasks score their texts in blocks.  The filter is broadcast if all parts together
have at most `broadcast_limit` bytes; beyond that, blocks send their distinct pairs to the
segments and get levels back.  The exact counts that the base score needs of words that
are not common always come back that way.  No key is sent more than once by a block, so
frequent words need no special care, and memory depends on the sizes of blocks and
segments alone.  Pairs are known by 48 bits of their hash, words by 64.

Defined results: a null or empty text is the end token alone; a null doc_id counts as
the empty text when training rows are chosen; repeated rows are learnt and scored again;
without training rows every base score is 0; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.llm._shared import MULT, WordHashes, encode, mix, remainder, scratch, small_batches, stash, table

START, END = np.uint64(0x5D588B656C078965), np.uint64(0x269EC3F3A2B7C5D1)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
PAIR_BITS = np.uint64(0xFFFFFFFFFFFF0000)

#: the ratio of counts that follow one another on the scale
WORD_BASE, PAIR_BASE = 1.12, 2.0
#: false positives of words, one in 256, only blur counts
WORD_PROBES, LEAST_PROBES = 8, 8
FALSE_COUNT = 400.0
COMMON = 1 << 18
SEGMENT_BYTES = 16 << 20
MAX_SEGMENTS = 1 << 16
TRAIN_BLOCK = 2_000_000
SCORE_BLOCK = 300_000
ANSWER_BYTES = 1 << 20

PART = "seg int, kind int, keys binary, counts binary"
REQUEST = "req long, kind int, seg int, payload binary"
RESPONSE = "req long, kind int, seg int, n int, counts binary, levels binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
WORDS, PAIRS, DOCS = 1, 2, 0
BUILT = "seg int, tokens long, distinct long, keys binary, counts binary, sizes array<long>, pairs binary, probes int, false double"
SPLIT = "seg int, keys binary, counts binary, words binary, word_probes int"


def _scale(base: float) -> np.ndarray:
    """What levels stand for: 0, 1, and whole counts whose ratio is about base."""
    out = [0, 1]
    while out[-1] < 1 << 43:  # less than 256 levels
        out.append(max(out[-1] + 1, round(out[-1] * base)))
    return np.array(out, dtype=np.float64)


WORD_SCALE, PAIR_SCALE = _scale(WORD_BASE), _scale(PAIR_BASE)


def level_of(keys: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Levels whose expected value is the count."""
    low = np.searchsorted(scale, counts, side="right") - 1
    part = (counts - scale[low]) / (scale[low + 1] - scale[low])
    chance = (mix(keys * MULT) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    return low + (chance < part)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def _bounds(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment's slice of sorted keys begins; one more at the end."""
    return np.searchsorted(segment_of(keys, segments), np.arange(segments + 1, dtype=np.uint64))


class LogBloom:
    """Filter parts of consecutive segments, laid out one after another."""

    def __init__(self, parts: dict[int, bytes], segments: int, probes: dict[int, int]):
        self.segments = segments
        size, self.probes = np.zeros(segments, dtype=np.int64), np.zeros(segments, dtype=np.int64)
        for seg, bits in parts.items():
            size[seg], self.probes[seg] = len(bits), probes[seg]
        self.offset = np.concatenate([[0], np.cumsum(size)[:-1]]) * 8
        self.size = size * 8
        self.bits = np.zeros(int(size.sum()) + 1, dtype=np.uint8)
        for seg, bits in parts.items():
            at = int(self.offset[seg]) // 8
            self.bits[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)

    @staticmethod
    def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.full(1, level, np.uint64) * MULT)
        return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)

    @classmethod
    def part(cls, keys: np.ndarray, levels: np.ndarray, probes: int) -> tuple[bytes, float]:
        """The bits, and the chance that all probes of an absent event hit."""
        events = int(levels.sum())
        if not events:
            return b"", 0.0
        size = -(-int(events * probes / np.log(2)) // 64) * 64
        held = np.zeros(size, dtype=bool)
        for q in range(1, int(levels.max()) + 1):
            a, b = cls._hashes(keys[levels >= q], q)
            for i in range(probes):
                held[(a + np.uint64(i) * b) % np.uint64(size)] = True
        return np.packbits(held, bitorder="little").tobytes(), float(held.mean()) ** probes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """By repeated membership probes: the last level in an unbroken run from 1."""
        out = np.zeros(len(keys), dtype=np.uint8)
        seg = segment_of(keys, self.segments).astype(np.int64)
        live = np.flatnonzero(self.size[seg] > 0)
        most = int(self.probes.max(initial=0))
        for q in range(1, 255):
            a, b = self._hashes(keys[live], q)
            own = seg[live]
            size, offset, probes = self.size[own].astype(np.uint64), self.offset[own], self.probes[own]
            held = np.ones(len(live), dtype=bool)
            for i in range(most):
                at = ((a + np.uint64(i) * b) % size).astype(np.int64) + offset
                held &= ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | (i >= probes)
                if i in (1, 4):  # most absent events are known by now
                    live, a, b, size, offset, probes = (x[held] for x in (live, a, b, size, offset, probes))
                    held = np.ones(len(live), dtype=bool)
            live = live[held]
            if not len(live):
                break
            out[live] = q
        return out


def _small(values: np.ndarray) -> bytes:
    """Counts in the least width that holds all of them; the reader knows how many there are."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted pair keys as differences, of 4 bytes each if they are small enough."""
    k = keys >> np.uint64(16)
    steps = np.diff(k)
    if len(steps) and int(steps.max()) >> 32:
        return b"\x08" + k.tobytes()
    return b"\x04" + k[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _unpacked_keys(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        k = np.frombuffer(raw, np.uint64, offset=1)
    else:
        k = np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), np.frombuffer(raw, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)
    return k << np.uint64(16)


def tokens_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words and of the end."""
    return np.append(hashes.of(encode(text).lower().split()), END)


def _pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the pairs that end at each token; first: where each text begins."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first] = START
    return mix(before * _PAIR + h) & PAIR_BITS


def _texts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks of whole texts with at least `block` tokens: rows, token hashes, starts."""
    hashes, rows, parts, n = WordHashes(), [], [], 0

    def packed():
        sizes = np.array([len(x) for x in parts])
        return rows, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)[:-1]])

    for batch in batches:
        others = [batch.column(i) for i in range(1, batch.num_columns)]
        for i, text in enumerate(batch.column(0)):
            parts.append(tokens_of(text.as_py(), hashes))
            rows.append(tuple(c[i].as_py() for c in others))
            n += len(parts[-1])
            if n >= block:
                yield packed()
                rows, parts, n = [], [], 0
    if parts:
        yield packed()


def _count_task(segments: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, first in _texts(batches, TRAIN_BLOCK):
            out = []
            for kind, keys in ((WORDS, h), (PAIRS, _pairs(h, first))):
                keys, counts = np.unique(keys, return_counts=True)
                at = _bounds(keys, segments)
                pack = _packed_keys if kind == PAIRS else np.ndarray.tobytes
                out += [(s, kind, pack(keys[a:b]), _small(counts[a:b])) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["seg", "kind", "keys", "counts"])

    return count


def _summed(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = pdf[pdf["kind"] == kind]
    if not len(own):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    each = [_unpacked_keys(k) if kind == PAIRS else np.frombuffer(k, np.uint64) for k in own["keys"]]
    counts = np.concatenate([_unpacked(c, len(k)) for c, k in zip(own["counts"], each, strict=True)])
    keys = np.concatenate(each)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def _build_task(segments: int, false_count: float):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = _summed(pdf, WORDS)
        pairs, pair_counts = _summed(pdf, PAIRS)
        # segments are hashed, so each has about its share of the distinct words
        probes = max(LEAST_PROBES, int(np.ceil(np.log2(max(1.0, len(words) * segments / false_count)))))
        bits, false = LogBloom.part(pairs, level_of(pairs, pair_counts, PAIR_SCALE), probes)
        sizes = np.bincount(np.searchsorted(WORD_SCALE, counts, side="right") - 1, minlength=len(WORD_SCALE))
        return pd.DataFrame({"seg": [int(pdf["seg"].iloc[0])], "tokens": [int(counts.sum())], "distinct": [len(words)], "keys": [words.tobytes()], "counts": [_small(counts)], "sizes": [sizes], "pairs": [bits], "probes": [probes], "false": [false]})

    return build


def _split_task(least: float, word_probes: int):
    """A segment's common words with their counts, and the filter of the others."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seg, raw, raw_counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.frombuffer(raw, np.uint64)
                counts = _unpacked(raw_counts, len(keys))
                often = counts >= least
                rest = keys[~often]
                bits, _ = LogBloom.part(rest, level_of(rest, counts[~often], WORD_SCALE), word_probes)
                out.append((seg, keys[often].tobytes(), _small(counts[often]), bits, word_probes))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["seg", "keys", "counts", "words", "word_probes"])

    return split


def train(documents: DataFrame, segments: int, path: str, false_count: float = FALSE_COUNT) -> DataFrame:
    """The model: a row per segment with its exact word counts and its filter of pairs."""
    parts = documents.select("text").mapInArrow(_count_task(segments), PART)
    return stash(parts.groupBy("seg").applyInPandas(_build_task(segments, false_count), BUILT), path)


def split_words(parts: DataFrame, path: str, common: int = COMMON, word_probes: int = WORD_PROBES) -> DataFrame:
    """At most `common` of the most frequent words, and filters of the others, by segment."""
    sizes = {r["pos"]: r["n"] for r in parts.select(F.posexplode("sizes").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    level, taken = len(WORD_SCALE), 0
    while level > 1 and taken + sizes.get(level - 1, 0) <= common:
        level -= 1
        taken += sizes.get(level, 0)
    least = float(WORD_SCALE[level]) if level < len(WORD_SCALE) else float("inf")
    return stash(parts.select("seg", "keys", "counts").mapInArrow(_split_task(least, word_probes), SPLIT), path)


class Common:
    """Exact counts of the common words."""

    def __init__(self, rows: list):
        keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in rows)])
        counts = np.concatenate([np.empty(0, np.int64), *(_unpacked(r["counts"], len(r["keys"]) // 8) for r in rows)])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        """Counts; -1 for words that are not common."""
        if not len(self.keys):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, self.counts[at], -1)


class Model:
    """Numbers that every score needs."""

    def __init__(self, tokens: int, distinct: int, texts: int, strength: float, false: float):
        self.tokens, self.distinct, self.texts, self.strength, self.false = tokens, distinct, texts, strength, false

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.distinct + 1.0))

    def probability(self, before: np.ndarray, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """From the counts read back of the context, the word and the pair."""
        single = (own + 1.0) / (self.tokens + self.distinct + 1.0)
        pair = np.where(own > 0, np.minimum(pair, before), 0.0)  # a pair is no more frequent than its context
        return np.where(before > 0, (pair + self.strength * single) / (before + self.strength + self.false), single)

    def log10(self, own: np.ndarray, pair: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per token, from the counts of the token and of the pair that ends at it."""
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = self.texts
        return np.log10(self.probability(before, own, pair))


class Filters:
    """The filters of words and of pairs; rows may come one at a time."""

    def __init__(self, words: list, pairs: list, segments: int):
        self.words = LogBloom({r["seg"]: bytes(r["words"]) for r in words}, segments, {r["seg"]: r["word_probes"] for r in words})
        self.pairs = LogBloom({r["seg"]: bytes(r["pairs"]) for r in pairs}, segments, {r["seg"]: r["probes"] for r in pairs})

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        return (self.words if kind == WORDS else self.pairs).levels(keys)


def _pack(index: np.ndarray, distinct: int) -> np.ndarray:
    return index.astype(np.uint16 if distinct <= 1 << 16 else np.uint32)


def _request_task(segments: int, model: Model, often, shared):
    """Blocks of texts, and the distinct keys that they ask the segments for."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, common = shared.value if shared is not None else None, often.value
        for k, (rows, h, first) in enumerate(_texts(batches, SCORE_BLOCK)):
            req = (TaskContext.get().partitionId() << 32) + k
            words, at = np.unique(h, return_inverse=True)
            pairs, pair_at = np.unique(_pairs(h, first), return_inverse=True)
            counts = common.of(words)
            rare = counts < 0
            mine = rare[at]
            place = np.cumsum(rare) - 1
            base = np.where(mine, 0.0, model.base(np.maximum(counts, 0))[at])
            doc = {"rows": rows, "n": np.diff(np.append(first, len(h))).astype(np.uint32), "rare_n": np.add.reduceat(mine, first, dtype=np.uint32), "rare_at": _pack(place[at[mine]], int(rare.sum())), "base": np.add.reduceat(base, first), "score": None}
            asked = [(WORDS, words[rare], np.ndarray.tobytes)]
            if bloom is not None:
                own = counts.astype(np.float64)
                own[rare] = WORD_SCALE[bloom.levels(WORDS, words[rare])]
                doc["score"] = np.add.reduceat(model.log10(own[at], PAIR_SCALE[bloom.levels(PAIRS, pairs)][pair_at], first), first)
            else:
                doc |= {"counts": counts, "at": _pack(at, len(words)), "pair_at": _pack(pair_at, len(pairs))}
                asked.append((PAIRS, pairs, _packed_keys))
            out = [(req, DOCS, -1, pickle.dumps(doc, 5))]
            for kind, keys, pack in asked:
                b = _bounds(keys, segments).tolist()
                out += [(req, kind, s, pack(keys[x:y])) for s, (x, y) in enumerate(zip(b[:-1], b[1:], strict=True)) if y > x]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["req", "kind", "seg", "payload"])

    return request


def _together(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Requests that are answered at once: with many segments a block asks each for few keys."""
    group = (np.cumsum(rows["payload"].str.len().to_numpy()) // ANSWER_BYTES).astype(np.int64)
    return (some for _, some in rows.groupby(group, sort=False))


def _answer_task(segments: int, routed: bool):
    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(asked):  # nobody asks this segment
            return pd.DataFrame(out, columns=["req", "kind", "seg", "n", "counts", "levels"])
        words, counts, bloom = np.empty(0, np.uint64), np.empty(0, np.int64), None
        if len(held):
            row = held.iloc[0]
            words = np.frombuffer(row["keys"], np.uint64)
            counts = _unpacked(row["counts"], len(words))
            bloom = Filters([row], [row], segments) if routed else None
        for kind, rows in asked.groupby("kind"):
            for some in _together(rows):
                parts = [np.frombuffer(p, np.uint64) if kind == WORDS else _unpacked_keys(p) for p in some["payload"]]
                keys = np.concatenate(parts)
                got, levels = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
                if kind == WORDS and len(words):
                    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                    got = np.where(words[at] == keys, counts[at], 0)
                if bloom is not None:
                    levels = bloom.levels(kind, keys)
                ends = np.cumsum([len(p) for p in parts]).tolist()
                for req, seg, x, y in zip(some["req"], some["seg"], [0, *ends[:-1]], ends, strict=True):
                    out.append((req, kind, seg, y - x, _small(got[x:y]) if kind == WORDS else b"", levels[x:y].tobytes() if routed else b""))
        return pd.DataFrame(out, columns=["req", "kind", "seg", "n", "counts", "levels"])

    return answer


def _score_task(model: Model):
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc = pickle.loads(docs["payload"].iloc[0])
        answers = answers.sort_values(["kind", "seg"])
        own = answers[answers["kind"] == WORDS]
        counts = np.concatenate([np.empty(0, np.int64), *(_unpacked(c, n) for c, n in zip(own["counts"], own["n"], strict=True))])
        n, rare_n = doc["n"].astype(np.int64), doc["rare_n"].astype(np.int64)
        of, mine = np.repeat(np.arange(len(n)), rare_n), counts[doc["rare_at"]]
        total = doc["score"]
        if total is None:
            values = doc["counts"].astype(np.float64)
            values[values < 0] = WORD_SCALE[np.frombuffer(b"".join(own["levels"]), np.uint8)]
            pair = PAIR_SCALE[np.frombuffer(b"".join(answers[answers["kind"] == PAIRS]["levels"]), np.uint8)]
            first = np.cumsum(n) - n
            total = np.add.reduceat(model.log10(values[doc["at"]], pair[doc["pair_at"]], first), first)
        return pd.DataFrame({
            "doc_id": pd.array([r[0] for r in doc["rows"]], dtype="Int64"),
            "held_out": [r[1] for r in doc["rows"]],
            "n_tokens": n,
            "n_known": n - rare_n + np.bincount(of, mine > 0, len(n)).astype(np.int64),
            "train_tokens": model.tokens,
            "base_score": doc["base"] + np.bincount(of, model.base(mine), len(n)),
            "score": total,
        })

    return score


def score(documents: DataFrame, held_out: Column, strength: float = 100.0, broadcast_limit: int = 192 << 20, path: str | None = None, false_count: float = FALSE_COUNT, word_probes: int = WORD_PROBES, common: int = COMMON) -> DataFrame:
    """Scores of all documents under a model of those that are not held out.

    documents need doc_id and text; strength is the weight of a word's own probability;
    false_count: see above; word_probes: probes of a word's event; common: words whose
    counts are broadcast.
    """
    spark = documents.sparkSession
    small_batches(spark)
    path = path or scratch(spark)
    docs = documents.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    segments = min(MAX_SEGMENTS, max(1, -(-size // SEGMENT_BYTES)))
    parts = train(learn, segments, f"{path}/model", false_count)
    split = split_words(parts, f"{path}/split", common, word_probes)
    sums = parts.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum(F.octet_length("pairs")).alias("b"), F.sum("false").alias("false")).first()
    bits = (sums["b"] or 0) + (split.agg(F.sum(F.octet_length("words"))).first()[0] or 0)
    model = Model(sums["n"] or 0, sums["v"] or 0, learn.count(), strength, (sums["v"] or 0) * (sums["false"] or 0.0) / segments)
    often = spark.sparkContext.broadcast(Common(list(split.select("keys", "counts").toLocalIterator())))
    shared, routed = None, bits > broadcast_limit
    if not routed:
        shared = spark.sparkContext.broadcast(Filters(list(split.select("seg", "words", "word_probes").toLocalIterator()), list(parts.select("seg", "pairs", "probes").toLocalIterator()), segments))
    blocks = stash(docs.mapInArrow(_request_task(segments, model, often, shared), REQUEST), f"{path}/blocks")
    asked = blocks.where(F.col("kind") != DOCS)
    held = parts.select("seg", "keys", "counts", *(("pairs", "probes") if routed else ()))
    if routed:
        held = held.join(split.select("seg", "words", "word_probes"), "seg")
    answers = asked.groupBy("seg").cogroup(held.groupBy("seg")).applyInPandas(_answer_task(segments, routed), RESPONSE)
    return blocks.where(F.col("kind") == DOCS).groupBy("req").cogroup(answers.groupBy("req")).applyInPandas(_score_task(model), SCORES)


def op1_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, remainder(F.col("doc_id"), 7) == 2)
