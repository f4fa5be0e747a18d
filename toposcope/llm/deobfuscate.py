"""Toxicity of texts after noisy-channel deobfuscation.

Suspicious tokens (leetspeak inside a word, letters repeated, single letters set apart)
become lattices: each sign may stand for letters, a repeated letter or a separator may be
dropped, all at a channel cost.  Viterbi decoding under a character trigram model chooses
the likeliest spelling: all pairs of last letters are kept, so it is exact.  The restored
spelling takes the place of the token; what is learnt and scored is the restored text.

A word's score is that of its most telling character n-gram: the lower confidence bound
of the share of toxic texts among the texts that hold it.  The text's score is a logistic
function of how many of its words are telling, and of their evidence.

Labels are learnt from all labelled texts that `learn` allows; n-grams are counted in Spark,
by folds, and the steps of the regression are sums that are made there.  The regression is
fitted on texts whose own fold was left out of the bounds, and the width of the bounds is
the one of WIDTHS with the least log loss over folds, so no held-out label is used.  Texts
are scored whole, and each distinct token is decoded once per task.

Defined results: null and empty texts have no words and get the score of a text without
telling words; without labels every score is 0; repeated rows are scored alike; texts
that occur again among the labelled ones count once; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import remainder, scratch, small_batches, stash, table

WORD = re.compile(r"[^\W\d_]+")
#: single signs set apart by one or two separators, at least three of them
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*~/·]{1,2}(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
#: what every match of SPACED ends with, quick to look for
_SPACED_END = re.compile(r"[ .\-_*~/·](?:[^\W_]|[@$!|+])[ .\-_*~/·]{1,2}(?:[^\W_]|[@$!|+])(?![^\W_])")
_SEPARATORS = frozenset(" .-_*~/·")
#: fixed values: letters that a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: leet signs inside a token or right before its letters, digits also after them
_LEET_INSIDE = re.compile(r"(?:[^\W\d_][^\W_]*[0-9@$!|+(<€£¡]+[^\W_]*[^\W\d_])|(?:^[0-9@$!|+(<€£¡]+[^\W\d_])|(?:[^\W\d_]{2}[0-9@$]+$)")
_REPEATED = re.compile(r"([^\W\d_])\1")
_STOPS = ".,;:"

#: where a token is cut before its parts are looked at
_CUT = re.compile(r"[\-_/.,;:\"'()\[\]{}*#%&?]+")

GRAMS = (4, 5, 6)
LEAST_TEXTS = 8
TELLING, SURE = 0.35, 0.8
WIDTHS = (1.0, 2.0, 3.0)
FOLDS = 3
CACHE = 1 << 19


def grams(word: str) -> set[str]:
    s = f"^{word}$"
    return {s, *(s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1))}


class CharModel:
    """Interpolated trigram model of the letters of words."""

    def __init__(self, trigrams: dict[str, float]):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        self.after_two, self.after_one, self.total, self.known = Counter(), Counter(), 0.0, {}
        for g, n in trigrams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.after_two[g[:2]] += n
            self.after_one[g[1]] += n
            self.total += n

    def cost(self, before: str, letter: str) -> float:
        got = self.known.get(before + letter)
        if got is None:
            one = (self.one[letter] + 0.5) / (self.total + 50)
            two = (self.two[before[1] + letter] + 4 * one) / (self.after_one[before[1]] + 4)
            got = -math.log((self.three.get(before + letter, 0) + 4 * two) / (self.after_two[before] + 4))
            if len(self.known) < CACHE:
                self.known[before + letter] = got
        return got

    def decode(self, observed: str) -> str:
        """The likeliest spelling of the observed signs (lower case)."""
        runs = []
        for c in observed:
            runs.append((c, runs[-1][1] + 1 if runs and runs[-1][0] == c else 1))
        long = {i for i, (c, n) in enumerate(runs) if n > 1 and (n > 2 or (i + 1 < len(runs) and runs[i + 1][1] > n))}
        done, before = [], "^^"
        # the best way to each pair of last letters: its cost, and its letters as a chain;
        # none where all ways have the same two, as what comes later then tells nothing of what came before
        states: dict[str, tuple[float, tuple | None]] | None = None
        for i, (c, n) in enumerate(runs):
            options = self.options(c, n, i in long)
            if states is None:
                if len(options) == 1:
                    if letter := options[0][0]:
                        before = before[1] + letter
                        done.append(letter)
                    continue
                states = {before: (0.0, None)}
            new: dict[str, tuple[float, tuple | None]] = {}
            for last, (cost, spelt) in states.items():
                for letter, channel in options:
                    total = cost + channel + (self.cost(last, letter) if letter else 0.0)
                    state = last[1] + letter if letter else last
                    if state not in new or total < new[state][0]:
                        new[state] = (total, (spelt, letter) if letter else spelt)
            states = new
            if len(states) == 1:
                ((before, (_, spelt)),) = states.items()
                done += self._letters(spelt)
                states = None
        if states is not None:
            _, best = min((cost + self.cost(b, "$"), b) for b, (cost, _) in states.items())
            done += self._letters(states[best][1])
        return "".join(done)

    @staticmethod
    def _letters(spelt: tuple | None) -> list[str]:
        out = []
        while spelt is not None:
            spelt, letter = spelt
            out.append(letter)
        return out[::-1]

    @staticmethod
    @lru_cache(1 << 14)
    def options(sign: str, run: int, long: bool) -> list[tuple[str, float]]:
        """Letters that a sign may stand for, "" where it may be dropped, with the costs of the channel."""
        if sign in _SEPARATORS:
            return [("", 0.0)]
        out = [(x, 0.5) for x in LEET.get(sign, "")]
        if not out or sign.isalnum():
            out.append((sign, 0.0 if sign.isalpha() else 6.0))
        if run > 1:
            out.append(("", 0.05 if long else 1.5))
        return out


class Restorer:
    """The words of a text, with restored spellings in the place of suspicious tokens."""

    def __init__(self, model: CharModel | None):
        self.model = model

    def _suspicious(self, bare: str) -> bool:
        if not bare.isalpha() and _LEET_INSIDE.search(bare):
            return not bare.isdigit()
        return bool(_REPEATED.search(bare))

    def of_token(self, token: str) -> list[str]:
        """Words of a token without white space, in lower case."""
        out = []
        if token.isalpha() and not (self.model and _REPEATED.search(token)):
            return [token]
        for part in _CUT.split(token) if self.model else ():
            bare = part.rstrip("!|")
            out += WORD.findall(self.model.decode(bare) if bare and self._suspicious(bare) else part)
        return out if self.model else WORD.findall(token)

    def spaced(self, low: str) -> list[str]:
        """Words whose letters are set apart."""
        if not self.model or not _SPACED_END.search(low):
            return []
        return [w for m in SPACED.finditer(low) for w in WORD.findall(self.model.decode(m.group()))]

    def words(self, text: str) -> set[str]:
        low = text.lower()
        return {w for token in set(low.split()) for w in self.of_token(token)}.union(self.spaced(low))


class Telling:
    """What the telling words of texts say, by one list of bounds or by several; tokens are remembered up to a limit."""

    def __init__(self, bounds: dict[str, float] | list[dict[str, float]], base: float, restorer: Restorer):
        lists = bounds if isinstance(bounds, list) else [bounds]
        self.base, self.restorer, self.lists = math.log(base / (1 - base)), restorer, len(lists)
        # tokens without a telling word, and the telling words of the others
        self.silent, self.seen = set(), {}
        # all telling n-grams at once: a whole word is one between its marks, others have few letters
        self.grams = ahocorasick.Automaton()
        for g in dict.fromkeys(g for own in lists for g in own):
            self.grams.add_word(g, tuple(own.get(g, 0.0) for own in lists))
        self.any = len(self.grams) > 0
        if self.any:
            self.grams.make_automaton()

    def _bounds_of(self, word: str) -> tuple[float, ...] | None:
        """The largest bound of the word's n-grams in each list."""
        found = [p for _, p in self.grams.iter(f"^{word}$")] if self.any else ()
        return tuple(map(max, zip(*found, strict=True))) if found else None

    def word(self, word: str) -> float:
        """The largest bound of the word's n-grams, in the first list."""
        return (self._bounds_of(word) or (0.0,))[0]

    def _told(self, words: list[str]) -> list[tuple[str, tuple[float, ...]]]:
        return [(w, p) for w in words if (p := self._bounds_of(w)) and max(p) >= TELLING]

    def features(self, text: str) -> list[float]:
        """FEATURES numbers of each list."""
        low = text.lower()
        found: dict[str, tuple[float, ...]] = {}
        for token in set(low.split()) - self.silent:
            told = self.seen.get(token)
            if told is None:
                core = token.rstrip(_STOPS)  # has the same words
                if core in self.silent:
                    self.silent.add(token)
                    continue
                told = self._told(self.restorer.of_token(core))
                if len(self.seen) + len(self.silent) >= CACHE:
                    self.seen.clear()
                    self.silent.clear()
                if told:
                    self.seen[token] = told
                else:
                    self.silent.add(token)
            found.update(told)
        found.update(self._told(self.restorer.spaced(low)))
        out: list[float] = []
        for i in range(self.lists):
            own = [p[i] for p in found.values() if p[i] >= TELLING]
            sure = sum(p >= SURE for p in own)
            evidence = math.fsum(math.log(p / (1 - p)) - self.base for p in own)  # whatever the order of the words
            out += [float(sure >= 1), float(min(sure, 3)), math.log1p(len(own) - sure), max(own, default=0.0), math.log1p(max(0.0, evidence))]
        return out


FEATURES = 5
#: files of the texts that are learnt from
LEARNERS = 64
#: n-grams that a task counts before it sends them on
COUNTED = 1 << 19
#: bits that tell which ids are labelled, in pieces of 4 KB
ID_BITS = 1 << 25


def lower_bound(toxic: np.ndarray, texts: np.ndarray, z: float) -> np.ndarray:
    """Wilson's lower bound of a share; 0 of too few texts."""
    n = np.maximum(texts, 1)
    p = toxic / n
    spread = np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return np.where(texts >= LEAST_TEXTS, (p + z * z / (2 * n) - z * spread) / (1 + z * z / n), 0.0)


def _letters_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the words of plain tokens; each text counts a token once."""

    def packed(tokens: Counter) -> pa.RecordBatch:
        words = [(w, n) for token, n in tokens.items() for w in ((token,) if token.isalpha() else WORD.findall(token))]
        # all words in one row of code points of 21 bits; what reaches beyond the end of a word is no trigram
        c = np.frombuffer("".join(f"^^{w}$" for w, _ in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inside = (c[:-2] != ord("$")) & (c[1:-1] != ord("$"))
        three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside]
        keys, at = np.unique(three, return_inverse=True)
        sums = np.bincount(at, np.repeat([n for _, n in words], [len(w) + 1 for w, _ in words]), len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(["".join(chr((k >> b) & 0x1FFFFF) for b in (42, 21, 0)) for k in keys.tolist()], pa.string()), pa.array(sums)], ["key", "n"])

    tokens: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            tokens.update(set(text.as_py().lower().split()))
            if len(tokens) >= COUNTED:
                yield packed(tokens)
                tokens.clear()
    yield packed(tokens)


class Places(dict):
    """Numbers of keys, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


class GramCounts:
    """n-grams of restored words, with texts and toxic texts by fold; those of a token are worked out once."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.of_tokens: dict[str, np.ndarray] = {}
        self.sums = np.zeros((2 * FOLDS, 1 << 12), np.int64)

    def _places_of(self, words: list[str]) -> np.ndarray:
        own: list[str] = []
        for w in words:
            s = f"^{w}$"
            own.append(s)
            for n in GRAMS:
                own += [s[i : i + n] for i in range(len(s) - n + 1)]
        return np.array([*map(self.places.__getitem__, own)], np.int64)

    def add(self, text: str, label: int, fold: int) -> None:
        low, parts = text.lower(), []
        for token in set(low.split()):
            own = self.of_tokens.get(token)
            if own is None:
                own = self.of_tokens[token] = self._places_of(self.restorer.of_token(token))
            parts.append(own)
        if spaced := self.restorer.spaced(low):
            parts.append(self._places_of(spaced))
        if not parts:
            return
        at = np.sort(np.concatenate(parts))
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        while len(self.places) > self.sums.shape[1]:
            self.sums = np.hstack([self.sums, np.zeros_like(self.sums)])
        self.sums[fold, at] += 1
        if label:
            self.sums[FOLDS + fold, at] += 1

    def packed(self) -> Iterator[pa.RecordBatch]:
        keys = [*self.places]
        for a in range(0, len(keys), 1 << 16):
            own = keys[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *(pa.array(c[a : a + len(own)]) for c in self.sums)], ["key", *COUNTS])
        self.clear()


def _count_task(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts(Restorer(shared.value))
        for batch in batches:
            for text, label, fold in zip(*(batch.column(i) for i in range(3)), strict=True):
                counts.add(text.as_py(), label.as_py(), fold.as_py())
                if len(counts.places) >= COUNTED or len(counts.of_tokens) >= COUNTED:
                    yield from counts.packed()
        yield from counts.packed()

    return count


COUNTS = [f"{kind}{f}" for kind in ("n", "t") for f in range(FOLDS)]


def _bounds(keys: list[str], counts: np.ndarray, left_out: int | None, z: float) -> dict[str, float]:
    """n-grams that tell something, without a fold."""
    folds = [f for f in range(FOLDS) if f != left_out]
    n, toxic = counts[:, folds].sum(axis=1), counts[:, [FOLDS + f for f in folds]].sum(axis=1)
    p = lower_bound(toxic, n, z)
    return {keys[i]: float(p[i]) for i in np.flatnonzero(p >= TELLING)}


def _logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _among(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose ids occur in ids, and a few others: texts without a label are not sent to the join.

    A bit for each hash of an id, 4 MB at most, is known to all tasks.
    """
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ID_BITS))
    piece, at = F.bitmap_bucket_number(own), F.bitmap_bit_position(own)
    bits = ids.groupBy(piece.alias("__piece")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = documents.join(F.broadcast(bits), piece == F.col("__piece"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*documents.columns)


def _labelled(documents: DataFrame, labels: DataFrame, learn: Column, path: str) -> DataFrame:
    """All labelled (text, toxic, fold) rows that may be learnt from, each text once."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = _among(documents.where(F.col("text").isNotNull()).select("doc_id", "text"), ids).withColumn("own", F.unhex(F.sha2("text", 256)))
    # labels are joined to hashes of texts, so texts are sent once, to as many files as tasks that are to learn
    known = rows.select("doc_id", "own").join(ids, "doc_id").groupBy("own").agg(F.max("toxic").cast("int").alias("toxic"))
    once = rows.select("own", "text").repartition(LEARNERS, "own").distinct().join(known, "own").select("text", "toxic")
    return stash(once.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(FOLDS)).cast("int")), f"{path}/learnt")


def _steps(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What rows add to a Newton step: the gradient, the Hessian and how many they are."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [len(y)]])


def _fit_all(rows: DataFrame, models: list[tuple[int, int | None]], ridge: float = 0.02, rounds: int = 40) -> dict[tuple[int, int | None], np.ndarray]:
    """Logistic regressions by Newton steps on rows (x, y, fold) that stay where they are: (width, fold left out) -> weights.

    All models take a step in one job, which brings sums of fixed size to the driver.
    """
    k = FEATURES + 1
    weights, open_ = {m: np.zeros(k) for m in models}, list(models)
    for _ in range(rounds):
        now = {m: weights[m] for m in open_}

        def steps(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = {m: np.zeros(k + k * k + 1) for m in now}
            for x, y, folds in _arrays(batches):
                for (i, out), w in now.items():
                    own = folds != out if out is not None else np.ones(len(y), bool)
                    if own.any():
                        z = np.hstack([x[own, i * FEATURES : (i + 1) * FEATURES], np.ones((own.sum(), 1))])
                        sums[i, out] += _steps(z, y[own], w)
            at = [(n, j, float(v)) for n, m in enumerate(now) for j, v in enumerate(sums[m])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*at, strict=True)], ["model", "place", "value"])

        added = rows.mapInArrow(steps, "model long, place long, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((len(open_), k + k * k + 1))
        for r in added:
            total[r["model"], r["place"]] = r["value"]
        moving = []
        for m, t in zip(open_, total, strict=True):
            c = ridge * t[-1] / 100
            step = np.linalg.solve(t[k:-1].reshape(k, k) + (c + 1e-6) * np.eye(k), t[:k] + c * weights[m])
            weights[m] = weights[m] - step
            if np.abs(step).max() > 1e-10:
                moving.append(m)
        open_ = moving
        if not open_:
            break
    return weights


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _losses(rows: DataFrame, weights: dict[tuple[int, int | None], np.ndarray]) -> list[float]:
    """Log loss of each width, of regressions that leave out each fold, on that fold: summed over all rows."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(WIDTHS))
        for x, y, folds in _arrays(batches):
            for (i, f), w in weights.items():
                own = folds == f
                p = np.clip(_logistic(x[own, i * FEATURES : (i + 1) * FEATURES], w), 1e-9, 1 - 1e-9)
                sums[i] -= float(np.where(y[own] > 0, np.log(p), np.log(1 - p)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(WIDTHS)), pa.int64()), pa.array(sums)], ["width", "loss"])

    found = {r["width"]: r["loss"] for r in rows.mapInArrow(losses, "width long, loss double").groupBy("width").agg(F.sum("loss").alias("loss")).collect()}
    return [found.get(i, 0.0) for i in range(len(WIDTHS))]


def score(documents: DataFrame, labels: DataFrame, learn: Column, restore: bool = True, path: str | None = None) -> DataFrame:
    """doc_id, score for every row of documents.

    learn: a condition on labels' doc_id; labels have doc_id and toxic (0 or 1); restore:
    if false, words are taken as they stand.
    """
    spark = documents.sparkSession
    small_batches(spark)
    path = path or scratch(spark)
    sample = _labelled(documents, labels, learn, path)
    # trigrams, n-grams that tell something and sums come to the driver: the model, which every task holds, and no texts
    letters = sample.select("text").mapInArrow(_letters_task, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")) if restore else None
    model = CharModel({r["key"]: math.sqrt(r["n"]) for r in letters.toLocalIterator()}) if restore else None
    shared = spark.sparkContext.broadcast(model)
    parts = sample.mapInArrow(_count_task(shared), ", ".join(["key string", *(f"{c} long" for c in COUNTS)]))
    sums = stash(parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]), f"{path}/counts")
    n, toxic = (sum((F.col(f"{kind}{f}") for f in range(FOLDS)), F.lit(0)) for kind in "nt")
    # no bound without a fold is above the share of all, if each toxic text of that fold is left out
    rows = sums.where(n >= LEAST_TEXTS).where(F.greatest(*[(toxic - F.col(f"t{f}")) / F.greatest(n - F.col(f"n{f}"), F.lit(1)) for f in range(FOLDS)], toxic / n) >= TELLING).collect()
    keys, counts = [r["key"] for r in rows], np.array([[r[c] for c in COUNTS] for r in rows], dtype=float).reshape(-1, 2 * FOLDS)
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    texts = sum(sizes.values())
    base = (sum(c for (t, _), c in sizes.items() if t) + 1) / (texts + 2)
    folded = spark.sparkContext.broadcast({z: [_bounds(keys, counts, f, z) for f in range(FOLDS)] for z in WIDTHS})

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the lists of all widths and folds at once: a text takes those of its own fold
        telling = Telling([folded.value[z][f] for f in range(FOLDS) for z in WIDTHS], base, Restorer(shared.value))
        per = FEATURES * len(WIDTHS)
        for batch in batches:
            x = [telling.features(t.as_py())[f * per : (f + 1) * per] for t, f in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "fold"])

    weights, bounds = None, {}
    if texts:
        learnt = stash(sample.mapInArrow(inputs, "x array<double>, y int, fold int"), f"{path}/inputs")
        folds = sorted({f for _, f in sizes})
        without = _fit_all(learnt, [(i, f) for i in range(len(WIDTHS)) for f in folds])
        loss = _losses(learnt, without)
        best = min(range(len(WIDTHS)), key=lambda i: (loss[i], i))
        weights, bounds = _fit_all(learnt, [(best, None)])[best, None], _bounds(keys, counts, None, WIDTHS[best])
    known = spark.sparkContext.broadcast(bounds)
    id_type = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = Telling(known.value, base, Restorer(shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                p = np.zeros(batch.num_rows)
                if weights is not None:
                    p = _logistic(np.array([telling.features(t.as_py() or "") for t in batch.column(1)]), weights)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op9_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
