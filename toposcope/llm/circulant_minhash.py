"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

A text's set is its distinct runs of `width` words (a shorter text is one run), hashed to
64 bits.  Two permutations make all signature coordinates: the first scatters the hashed
elements over a circle of 2**20 places, the second ranks the places, and coordinate k is
the least rank after turning the circle by k.  Texts of one set become one class at once.
Classes that share a band are candidates, and a candidate pair is a link only if the full
sets confirm it.

Not all pairs of a bucket are made.  First every member is held against the leader that
it meets most often; confirmed links join components.  Then only pairs across components
are looked at, in blocks of bounded size, and only those whose signatures agree enough.
Each seeking text is first verified against its FIRST most similar partners.  Texts that
have more partners than that then meet all of them in blocks that hold the whole sets,
and a block gives back only links that join components.  So each pair that shares a band
and agrees enough is verified or already joined, whatever the size of its bucket.  Pairs
are made inside blocks only; a bucket of texts that stay unlinked is copied once per
BLOCK of its members, as its pairs can be told apart in no other way.

At the default 32 bands of 4 coordinates a pair at similarity 0.8 shares no band with
probability 5e-8, and falls below the agreement asked for with probability 8e-8.

Defined results: null and empty texts and those without words have an empty set and are
linked with nothing; a null doc_id is linked with nothing and kept; repeated rows of one
doc_id are one document; rows of an empty table give an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import WordHashes, encode, mix, scratch, small_batches, stash, table
from toposcope.llm.components import connected, joined

CIRCLE_BITS = 20
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: a pair at similarity 0.8 agrees in fewer of 128 coordinates with a probability of 8e-8
AGREE = 0.594
#: seekers and targets of a block, and their elements where whole sets come along
BLOCK = 4096
ELEMENTS = 1_000_000
#: partners that a seeking text is held against before all others
FIRST = 8
#: up to so many classes with a shared band are broadcast to find their texts; beyond, texts are shuffled
BROADCAST_CLASSES = 1_000_000
PAIRS = 50_000
_JOIN = np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _circle() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of COORDINATES ranks around the circle."""
    rng = np.random.default_rng(20)
    scatter = rng.permutation(1 << CIRCLE_BITS).astype(np.int64)
    rank = rng.permutation(1 << CIRCLE_BITS).astype(np.uint32)
    rank = np.concatenate([rank, rank[: COORDINATES - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(rank, COORDINATES)


def shingles(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    size = min(width, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _JOIN + h[k : k + n])
    return np.unique(out)


def signature(elements: np.ndarray) -> np.ndarray:
    """COORDINATES least ranks, of which the low 16 bits are kept."""
    scatter, windows = _circle()
    places = np.unique(scatter[(elements >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)])
    least = None
    for at in range(0, len(places), 2048):
        part = windows[places[at : at + 2048]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint16)


def _sets_task(width: int, keep_sets: bool):
    """Rows of (doc_id, text) to ids, sizes, fingerprints and signatures or whole sets.

    For whole sets a third column has the fingerprint that is wanted of the text.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, prints, last = [], [], []
                for text in batch.column(1):
                    elements = shingles(encode(text.as_py()).lower().split(), hashes, width)
                    n.append(len(elements))
                    raw = elements.tobytes()
                    prints.append(hashlib.blake2b(raw, digest_size=16).digest() if n[-1] else None)
                    last.append(None if not n[-1] else raw if keep_sets else signature(elements).tobytes())
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(last, pa.binary())], ["doc_id", "n", "print", "elements" if keep_sets else "sig"])
                yield out.filter(pa.array([a == b for a, b in zip(prints, batch.column(2).to_pylist(), strict=True)], pa.bool_())) if keep_sets else out

    return make


def _schema(id_type: T.DataType, last: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField(last, T.BinaryType())])


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Do enough coordinates agree?"""
    if not len(a):
        return pd.Series([], dtype=bool)
    x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, COORDINATES)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, COORDINATES)
    return pd.Series((x == y).mean(axis=1) >= AGREE)


def _confirm_task(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, one, other, own = [], None, b"", np.empty(0, np.uint64)
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                y = np.frombuffer(b.as_buffer(), np.uint64)
                other = a.as_buffer().to_pybytes()
                if other != one:
                    one, own = other, np.frombuffer(other, np.uint64)
                at = np.minimum(np.searchsorted(own, y), len(own) - 1)
                shared = int((own[at] == y).sum())
                held.append(100 * shared >= percent * (len(own) + len(y) - shared))
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return confirm


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """The pairs (a, b) of which the full sets are similar enough."""
    pairs = stash(pairs, path)
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if needed.count() <= BROADCAST_CLASSES:  # only the sets of these are shuffled
        sets = sets.join(F.broadcast(needed), "doc_id", "left_semi")
    one = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    kind = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    return pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(_confirm_task(percent), kind)


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int, path: str) -> DataFrame:
    """(doc_id, elements) of the wanted (doc_id, want); want is the fingerprint of the set."""
    wanted = stash(wanted, f"{path}-wanted")
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_CLASSES else wanted
    rows = docs.join(side, "doc_id").select("doc_id", "text", "want").mapInArrow(_sets_task(width, True), _schema(docs.schema["doc_id"].dataType, "elements"))
    sets = stash(rows.select("doc_id", "elements"), path)
    # rows that repeat a doc_id and its text
    return sets if sets.count() == n else stash(sets.dropDuplicates(["doc_id"]), f"{path}-once")


def _band(sig, k):
    return F.substring(sig, k * (2 * ROWS) + 1, 2 * ROWS)


class _Sets:
    """Elements of a batch's sets, renumbered, to count what one set shares with many."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(r) // 8 for r in raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        names, self.flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=np.int64)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.start[one] : self.start[one] + self.size[one]]
        self.mark[own] = 1
        n = self.size[others]
        at = np.repeat(self.start[others] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.add.reduceat(self.mark[self.flat[at]], np.cumsum(n) - n)
        self.mark[own] = 0
        return out


class _Roots:
    """Components of a batch's rows, joined as links are found."""

    def __init__(self, comp: np.ndarray):
        names, self.at = np.unique(comp, return_inverse=True)
        self.root = np.arange(len(names))

    def join(self, x: int, y: int) -> bool:
        """Join the components of two rows; False if they were one."""
        u, v = self._find(self.at[x]), self._find(self.at[y])
        self.root[max(u, v)] = min(u, v)
        return u != v

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x


def _joining(found: np.ndarray, roots: _Roots, sets: _Sets, percent: int) -> np.ndarray:
    """The confirmed ones of the pairs that join components which nothing has joined in this batch."""
    keep = []
    edges = np.flatnonzero(np.concatenate([[True], found[0, 1:] != found[0, :-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        x, others = int(found[0, a]), found[1, a:b]
        both = sets.shared(x, others)
        for i in np.flatnonzero(100 * both >= percent * (sets.size[x] + sets.size[others] - both)).tolist():
            if roots.join(x, int(others[i])):
                keep.append(a + i)
    return found[:, keep]


def _seek(t: dict[str, np.ndarray], limit: int | None, percent: int) -> list[np.ndarray]:
    """Within blocks: partners of each seeker in other components, best first.

    t has rows of whole blocks, in each block its targets before its seekers.  Without a
    limit t has the sets too, and only confirmed pairs that join components are given.
    So many seekers are taken at a time that their pairs fit in memory, and what is kept
    of them is bounded by the rows of t.
    """
    start = np.flatnonzero(np.concatenate([[True], t["block"][1:] != t["block"][:-1]]))
    of_block = np.cumsum(np.concatenate([[True], t["block"][1:] != t["block"][:-1]])) - 1
    targets = np.add.reduceat((~t["seeks"]).astype(np.int64), start)
    seekers = np.flatnonzero(t["seeks"])
    many = targets[of_block[seekers]]
    out, done = [], 0
    edges = np.cumsum(many)
    sets = roots = None
    while done < len(seekers):
        stop = max(done + 1, int(np.searchsorted(edges, (edges[done - 1] if done else 0) + PAIRS, side="right")))
        own, n = seekers[done:stop], many[done:stop]
        done = stop
        one = np.repeat(own, n)
        other = np.repeat(start[of_block[own]], n) + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        a, b = t["n"][one], t["n"][other]
        # of a pair without a pending end all is known
        near = (t["comp"][one] != t["comp"][other]) & (t["pending"][one] | t["pending"][other]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        one, other = one[near], other[near]
        # a pair is looked at in the first band that it shares
        first = (t["sig"][one].view(np.uint64) == t["sig"][other].view(np.uint64)).argmax(axis=1) == t["band"][one]
        one, other = one[first], other[first]
        agree = (t["sig"][one] == t["sig"][other]).sum(axis=1)
        good = agree >= AGREE * COORDINATES
        found = np.stack([one[good], other[good], agree[good]])
        found = found[:, np.lexsort((t["rid"][found[1]], -found[2], found[0]))]
        if not found.shape[1]:
            continue
        if limit is None:
            if sets is None:
                sets, roots = _Sets(t["elements"]), _Roots(t["comp"])
            found = _joining(found, roots, sets, percent)
        begins = np.flatnonzero(np.concatenate([[True], found[0, 1:] != found[0, :-1]])) if found.shape[1] else np.empty(0, np.int64)
        of = np.diff(np.append(begins, found.shape[1]))
        rank = np.arange(found.shape[1]) - np.repeat(begins, of)
        keep = rank < (limit if limit is not None else found.shape[1] + 1)
        out.append(np.concatenate([found, np.repeat(of, of)[None]])[:, keep])
    found = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
    return [t["rid"][found[0]], t["rid"][found[1]], found[2], found[3]]


def _seek_task(limit: int | None, percent: int):
    """Over rows sorted by block: whole blocks at a time, of any number of small ones."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in _and_last(batches):
            if batch is not None:
                kept = pa.concat_batches([kept, batch]) if kept is not None else batch
            if kept is None or not kept.num_rows:
                continue
            block = kept.column(0).to_numpy(zero_copy_only=False)
            # the last block may go on in the next batch
            end = len(block) if batch is None else int(np.searchsorted(block, block[-1]))
            whole, kept = kept.slice(0, end), kept.slice(end)
            if not whole.num_rows:
                continue
            names = ("block", "seeks", "band", "rid", "comp", "n", "pending")
            t = {k: whole.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            t["sig"] = np.frombuffer(b"".join(whole.column(7).to_pylist()), np.uint16).reshape(-1, COORDINATES)
            if limit is None:
                t["elements"] = whole.column(8).to_pylist()
            cols = _seek(t, limit, percent)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], whole.column(3).type), pa.array(cols[1], whole.column(3).type), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int64))], ["seeker", "other", "agree", "of"])

    return seek


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _blocks(rows: DataFrame, with_sets: bool) -> DataFrame:
    """Rows of open buckets dealt to blocks in which seekers meet targets.

    A bucket's largest component only waits to be found; all other pending members seek,
    and those that are not pending do too if the largest component has pending members.
    Every seeker of a bucket meets every target of it.  A block has at most about BLOCK
    seekers and BLOCK targets, and if whole sets come along, about ELEMENTS elements of
    each; up to that size a bucket is one block, and nothing is copied.
    """
    by_component = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("e"), F.max("pending").alias("p"))
    sizes = by_component.groupBy("bucket").agg(F.sum("c").alias("all"), F.sum("e").alias("elements"), F.max(F.struct("c", "comp", "e", "p")).alias("top"))
    sizes = sizes.select("bucket", "all", "elements", F.col("top.comp").alias("body"), F.col("top.p").alias("owed"), (F.col("all") - F.col("top.c")).alias("m"), (F.col("elements") - F.col("top.e")).alias("own")).where("m > 0")

    def dealt(count: str, elements: str):
        share = F.col(count) / BLOCK
        return F.ceil(F.greatest(share, F.col(elements) / ELEMENTS) if with_sets else share).cast("int")

    sized = rows.join(sizes.withColumn("chunks", dealt("m", "own")).withColumn("parts", dealt("all", "elements")), "bucket")
    cols = ["bucket", "band", "rid", "comp", "n", "pending", "sig"]
    own = F.xxhash64("rid")
    targets = sized.select(*cols, F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(own, F.col("parts")).cast("int").alias("part"))
    seekers = sized.where("comp <> body and (pending or owed)").select(*cols, F.lit(True).alias("seeks"), F.pmod(own, F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return targets.unionByName(seekers)


def components(documents: DataFrame, width: int = 5, percent: int = 80, path: str | None = None) -> DataFrame:
    """A row per row of documents: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * intersection >= percent * union of their sets.
    """
    spark = documents.sparkSession
    small_batches(spark)
    path = path or scratch(spark)
    docs = documents.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType
    sigs = stash(docs.mapInArrow(_sets_task(width, False), _schema(id_type, "sig")), f"{path}/sigs")
    linkable = sigs.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stash(linkable.groupBy("print").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("sig").alias("sig")), f"{path}/classes")

    banded = classes.select("rid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, _band(F.col("sig"), k)))).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c"), F.min("rid").alias("leader")).where("c > 1")
    members = stash(banded.join(shared.drop("c"), "key"), f"{path}/members")

    sets = _whole_sets(docs, classes.join(members.select("rid").distinct(), "rid", "left_semi").select(F.col("rid").alias("doc_id"), F.col("print").alias("want")), width, f"{path}/sets")
    own = classes.select(F.col("rid"), "n", "sig")
    # the leader that a class meets most often
    star = members.where("rid <> leader").groupBy("rid", "leader").count().groupBy(F.col("rid").alias("b")).agg(F.max_by("leader", F.struct("count", "leader")).alias("a"))
    left = own.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = own.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    star = star.join(right, "b").join(left, "a").where(sized).where(_alike("sa", "sb")).select("a", "b")
    links = stash(confirm(star, sets, percent, f"{path}/star"), f"{path}/links0")
    labels = connected(links, f"{path}/cc0")

    pending = None
    kind = T.StructType([T.StructField("seeker", id_type), T.StructField("other", id_type), T.StructField("agree", T.IntegerType()), T.StructField("of", T.LongType())])
    for k, limit in enumerate((FIRST, None), 1):
        known = members.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("band", "key", "rid", F.coalesce("label", "rid").alias("comp"))
        split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        rows = known.join(split, "key", "left_semi")
        if pending is None:
            rows = rows.withColumn("pending", F.lit(True))
        else:
            rows = rows.join(pending.select(F.col("seeker").alias("rid"), F.lit(True).alias("p")), "rid", "left").withColumn("pending", F.coalesce("p", F.lit(False)))
            rows = rows.join(rows.where("pending").select("key").distinct(), "key", "left_semi")
        rows = rows.join(own, "rid").select(F.col("key").alias("bucket"), "band", "rid", "comp", "n", "sig", "pending")
        rows = stash(rows, f"{path}/open{k}")
        if rows.isEmpty():
            break
        dealt = _blocks(rows, limit is None).select(F.xxhash64("bucket", "chunk", "part").alias("block"), "seeks", "band", "rid", "comp", "n", "pending", "sig")
        if limit is None:
            dealt = dealt.join(sets.select(F.col("doc_id").alias("rid"), "elements"), "rid").select(*dealt.columns, "elements")
        dealt = dealt.repartition("block").sortWithinPartitions("block", "seeks", "rid")
        sought = stash(dealt.mapInArrow(_seek_task(limit, percent), kind), f"{path}/sought{k}")
        best = sought
        if limit is not None:
            order = Window.partitionBy("seeker").orderBy(F.col("agree").desc(), "other")
            best = sought.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
        pairs = best.select(F.least("seeker", "other").alias("a"), F.greatest("seeker", "other").alias("b")).distinct()
        found = stash(confirm(pairs, sets, percent, f"{path}/pairs{k}") if limit else pairs, f"{path}/found{k}")
        if not found.isEmpty():
            labels = joined(labels, found, f"{path}/cc{k}")
        if limit is None:
            break
        # of: candidates of the seeker in the block, of which at most `limit` were given
        each = sought.groupBy("seeker").agg(F.count("*").alias("c"), F.max("of").alias("of"))
        pending = stash(each.where((F.col("of") > limit) | (F.col("c") > limit)).select("seeker"), f"{path}/pending{k}")
        if pending.isEmpty():
            break

    named = classes.select("print", F.col("rid").alias("node")).join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("component_id"))
    out = linkable.select("doc_id", "n", "print").join(named, "print").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sigs.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents without all but the smallest doc_id of each group, and one row of each doc_id.

    Of rows that repeat a doc_id the one of the least text stays; rows without a doc_id all stay.
    """
    found = components(documents, width, percent)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    out = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    twice = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return out
    # only rows of repeated ids are shuffled once more
    whole = F.struct(*documents.columns)
    again = out.join(twice, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(whole, F.struct(F.col("text"), F.xxhash64(whole))).alias("__row"))
    return out.join(twice, "doc_id", "left_anti").select(*documents.columns).unionByName(again.select("__row.*"))


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), width=2)
