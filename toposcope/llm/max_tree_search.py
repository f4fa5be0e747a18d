"""Ranked lexical search by best-first branch and bound over max trees, exact.

Documents are cut into segments of at most SEGMENT documents, in the order in which tasks
read them.  A segment holds, for each term, a tree over its document ranges: the leaves are
the term's scores in documents, each node the largest score below it, for ranges of 16, 256
and all documents of the segment.  The sum of an item's weights times the maxima of its
terms bounds what any document of a range can score.

A search takes three passes over the written index, all with the items broadcast:

1. the roots alone are read, and each item gets the segment with its largest root bound;
2. each item is searched in that segment; its tenth score is a threshold that holds everywhere;
3. every segment is searched from the threshold on.

Within a segment the range with the highest bound is opened first, until bounds fall below
the threshold, which rises with what has been found.  Ranges whose bound equals it are
opened too, as a document of the same score and a smaller id may be there.  Tasks pass on ten
documents of an item at most; ranks come from those.

Items come in parts of at most PART_BYTES of text, which bounds what is broadcast and what
the driver holds.  With one part, only terms of its items are indexed; with more, all terms
are indexed, once.  All scores are 64-bit integers.

Defined results: a null text has no terms, and a document or item without terms is in no
result; repeated documents are ranked each; documents without an id come last among equal
scores; equal rows of the items count once, and the terms of rows that share an item_id are
taken together; with no documents or no items there are no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toposcope.llm._shared import UPPER, ascii_lower, scratch, stash, table

TOP = 10
#: documents of a segment, and postings after which one ends early
SEGMENT, SEGMENT_POSTINGS = 4096, 1 << 19
#: documents of a node, from the leaves up: 2 ** SHIFT
SHIFTS = (4, 8)
PART_BYTES = 16 << 20
#: letters A to Z become lower-case, ASCII bytes that are neither letters nor digits become spaces
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LISTS = "ids array<bigint>, lengths array<int>, terms array<binary>, dfs array<int>, places array<int>, tfs array<int>"
SEGMENTS = f"segment bigint, n_docs bigint, n_terms bigint, {_LISTS}"
INDEX = "segment bigint, ids array<bigint>, terms array<binary>, roots array<bigint>, size1 array<int>, node1 array<int>, max1 array<bigint>, first1 array<int>, size0 array<int>, node0 array<int>, max0 array<bigint>, first0 array<int>, places array<int>, scores array<bigint>"


def _lists(kinds: str) -> pa.Schema:
    """An Arrow schema of a Spark one that has numbers and arrays only."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [x.split(" ") for x in kinds.split(", ")]
    return pa.schema([(n, pa.list_(types[t[6:-1]]) if t.startswith("array") else types[t]) for n, t in pairs])


def _row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


@dataclass
class _Segment:
    """Postings as they are gathered; documents without an indexed term count, but get no place."""

    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    postings: dict = field(default_factory=dict)
    n_docs: int = 0
    n_terms: int = 0
    size: int = 0

    def add(self, doc_id: int | None, length: int, counts: Counter) -> None:
        self.n_docs += 1
        self.n_terms += length
        if counts:
            place = len(self.ids)
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.size += len(counts)
            for term, tf in counts.items():
                places, tfs = self.postings.setdefault(term, ([], []))
                places.append(place)
                tfs.append(tf)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT or self.size >= SEGMENT_POSTINGS

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        lists = self.postings.values()
        flat = [np.fromiter(chain.from_iterable(x[i] for x in lists), np.int32, self.size) for i in (0, 1)]
        return _row([number, self.n_docs, self.n_terms, self.ids, self.lengths, list(self.postings), [len(x[0]) for x in lists], *flat], schema)


def _build_task(shared):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, schema = shared.value, _lists(SEGMENTS)
        number, held = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").translate(ALNUM).split()
                if not words:
                    continue
                held.add(doc_id, len(words), Counter(words if wanted is None else filter(wanted.__contains__, words)))
                if held.full():
                    yield held.row(number, schema)
                    number, held = number + 1, _Segment()
        if held.n_docs:
            yield held.row(number, schema)

    return build


def _nodes(term: np.ndarray, place: np.ndarray, score: np.ndarray, n_terms: int) -> tuple:
    """Maxima of runs of equal term and place: how many each term has, their places, maxima and first rows."""
    if not len(term):
        return np.zeros(n_terms, np.int32), *(np.zeros(0, np.int64) for _ in range(3))
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
    return np.bincount(term[first], minlength=n_terms), place[first], np.maximum.reduceat(score, first), first


def _tree_task(n_docs: int, n_terms: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _lists(INDEX)
        for batch in batches:
            for i in range(batch.num_rows):
                segment, _, _, ids, lengths, terms, dfs, places, tfs = (batch.column(k)[i] for k in range(9))
                n, df, place, tf = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, dfs, places, tfs))
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                score = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
                term = np.repeat(np.arange(len(df)), df)
                size0, node0, max0, first0 = _nodes(term, place >> SHIFTS[0], score, len(df))
                term0 = np.repeat(np.arange(len(df)), size0)
                size1, node1, max1, first1 = _nodes(term0, node0 >> (SHIFTS[1] - SHIFTS[0]), max0, len(df))
                root = _nodes(np.repeat(np.arange(len(df)), size1), np.zeros(len(node1), np.int64), max1, len(df))[2]
                yield _row([segment.as_py(), ids.values, terms.values, root, size1, node1, max1, first1, size0, node0, max0, first0, place, score], schema)

    return trees


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one behind the other."""
    size = last - first
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


@dataclass
class Items:
    """Items of a part: for each its terms, as places in a vocabulary, and their weights times repeats."""

    terms: list[bytes]
    of: np.ndarray  # item of each entry
    term: np.ndarray
    weight: np.ndarray
    n: int

    def bounds(self, largest: np.ndarray) -> np.ndarray:
        """Bound of each item, by the largest score of each term."""
        return _sums(self.of, self.weight * largest[self.term], self.n)


class _Found:
    """The best documents of an item in this task."""

    def __init__(self, least: int):
        self.least, self.heap = max(1, least), []

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < TOP:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == TOP:
            self.least = max(self.least, self.heap[0][0])


class _Tree:
    """A segment of the index."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        values = lambda k: batch.column(k)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = batch.column(1)[i]
        sizes, self.node, self.largest, self.first = zip(*([values(k) for k in range(a, a + 4)] for a in (8, 4)), strict=True)
        self.start = [np.r_[0, np.cumsum(x)] for x in sizes]
        self.place, self.score = values(12), values(13)

    def _level(self, k: int, rows: np.ndarray, weight: np.ndarray) -> tuple:
        """Entries of a level, their weights, and bounds by node."""
        entries = _ranges(self.start[k][rows], self.start[k][rows + 1])
        own = np.repeat(weight, self.start[k][rows + 1] - self.start[k][rows])
        return entries, own, _sums(self.node[k][entries], own * self.largest[k][entries], -(-len(self.ids) >> SHIFTS[k]))

    def search(self, rows: np.ndarray, weight: np.ndarray, found: _Found) -> int:
        """Best first through nodes and leaves; returns the number of leaf ranges opened."""
        _, _, upper = self._level(1, rows, weight)
        if upper.max(initial=0) < found.least:
            return 0
        entries, own, lower = self._level(0, rows, weight)
        by_node = np.argsort(self.node[0][entries], kind="stable")
        entries, own = entries[by_node], own[by_node]
        edges = np.searchsorted(self.node[0][entries], np.arange(len(lower) + 1))
        last = np.r_[self.first[0][1:], len(self.place)]
        queue = [(-int(b), 1, int(i)) for i, b in enumerate(upper) if b >= found.least]
        heapq.heapify(queue)
        fan, opened = 1 << (SHIFTS[1] - SHIFTS[0]), 0
        while queue and -queue[0][0] >= found.least:
            _, level, node = heapq.heappop(queue)
            if level:
                for child in range(node * fan, min((node + 1) * fan, len(lower))):
                    if lower[child] >= found.least:
                        heapq.heappush(queue, (-int(lower[child]), 0, child))
                continue
            opened += 1
            e = slice(edges[node], edges[node + 1])
            leaves = _ranges(self.first[0][entries[e]], last[entries[e]])
            each = np.repeat(own[e], last[entries[e]] - self.first[0][entries[e]])
            base = node << SHIFTS[0]
            scores = _sums(self.place[leaves] - base, each * self.score[leaves], 1 << SHIFTS[0])
            for j in np.flatnonzero(scores >= found.least):
                found.add(int(scores[j]), self.ids[base + int(j)].as_py())
        return opened


def _rows_of(terms: list[bytes], vocabulary: dict[bytes, int], n: int) -> np.ndarray:
    """Where each term of the vocabulary is in a segment; -1 if it is not."""
    out = np.full(n, -1, np.int64)
    for row, term in enumerate(terms):
        if (k := vocabulary.get(term)) is not None:
            out[k] = row
    return out


def _roots_task(shared):
    """Each item's segment of the largest root bound in this task."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        vocabulary = {t: i for i, t in enumerate(items.terms)}
        best, where = np.zeros(items.n, np.int64), np.zeros(items.n, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _rows_of(batch.column(1)[i].as_py(), vocabulary, len(items.terms))
                root = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                largest = np.where(rows >= 0, root[rows], 0) if len(root) else np.zeros(len(rows), np.int64)
                bounds = items.bounds(largest)
                better = bounds > best
                best[better], where[better] = bounds[better], batch.column(0)[i].as_py()
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, best[some], where[some])], ["item", "bound", "segment"])

    return roots


def _search_task(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least, only = shared.value
        vocabulary = {t: i for i, t in enumerate(items.terms)}
        edges = np.searchsorted(items.of, np.arange(items.n + 1))
        found: dict[int, _Found] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _rows_of(batch.column(2)[i].as_py(), vocabulary, len(items.terms))
                root = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                if not len(root):
                    continue
                bounds, tree = items.bounds(np.where(rows >= 0, root[rows], 0)), None
                for item in np.flatnonzero(bounds >= least) if only is None else only.get(batch.column(0)[i].as_py(), ()):
                    own = found.setdefault(int(item), _Found(int(least[item])))
                    if bounds[item] < own.least:
                        continue
                    tree = tree or _Tree(batch.slice(i, 1).select([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]), 0)
                    e = slice(edges[item], edges[item + 1])
                    here = rows[items.term[e]] >= 0
                    tree.search(rows[items.term[e]][here], items.weight[e][here], own)
        out = [(k, -x[2] if x[1] else None, x[0]) for k, f in found.items() for x in f.heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return search


class LexicalIndex:
    """A written index of documents (doc_id, text); `terms` restricts it to these."""

    def __init__(self, docs: DataFrame, terms: frozenset[bytes] | None = None):
        self.spark = docs.sparkSession
        path = scratch(self.spark)
        shared = self.spark.sparkContext.broadcast(terms)
        plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
        self.segments = stash(plain.mapInArrow(_build_task(shared), SEGMENTS), f"{path}/segments")
        sums = self.segments.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
        self.n_docs, self.n_terms = sums["n"], sums["l"]
        self.index = stash(self.segments.mapInArrow(_tree_task(self.n_docs, self.n_terms), INDEX), f"{path}/index")

    def weighted(self, items: list[list[bytes]]) -> Items:
        """Items by their terms (repeats included), with weights from all documents."""
        counts = [Counter(x) for x in items]
        terms = sorted(set(chain.from_iterable(counts)))
        place = {t: i for i, t in enumerate(terms)}
        wanted = self.spark.createDataFrame([(t,) for t in map(bytearray, terms)], "term binary")
        each = self.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
        df = {bytes(r["term"]): r["df"] for r in each.join(wanted, "term", "left_semi").collect()}
        # terms that no document holds have no postings either
        entries = [(i, place[t], reps * math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df[t] + 1)))) for i, c in enumerate(counts) for t, reps in sorted(c.items()) if t in df]
        of, term, weight = (np.array([x[k] for x in entries], np.int64) for k in range(3))
        return Items(terms, of, term, weight, len(items))

    def search(self, items: Items) -> DataFrame:
        """item (its number), doc_id, score: TOP best documents of each item, for each task some more."""
        context = self.spark.sparkContext
        nearest = self.index.select("segment", "terms", "roots").mapInArrow(_roots_task(context.broadcast(items)), "item bigint, bound bigint, segment bigint")
        starts = nearest.groupBy("item").agg(F.max(F.struct("bound", "segment")).alias("b")).select("item", "b.segment").collect()
        only: dict[int, list[int]] = {}
        for r in starts:
            only.setdefault(r["segment"], []).append(r["item"])
        least = np.ones(items.n, np.int64)
        kinds = "item bigint, doc_id bigint, score bigint"
        own = self.index.join(F.broadcast(self.spark.createDataFrame([(s,) for s in only], "segment bigint")), "segment", "left_semi")
        seeds = own.mapInArrow(_search_task(context.broadcast((items, least, only))), kinds)
        for r in seeds.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
            if r["n"] == TOP:
                least[r["item"]] = r["least"]
        return self.index.mapInArrow(_search_task(context.broadcast((items, least, None))), kinds)


def ranked_search(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score for items (item_id, text) against docs (doc_id, text)."""
    spark = docs.sparkSession
    texts = items.select("item_id", "text").distinct()
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    parts = max(1, -(-size // part_bytes))
    terms = texts.groupBy("item_id").agg(F.flatten(F.collect_list(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("terms")).where(F.size("terms") > 0)
    index, out = None, None
    for part in range(parts):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect() if parts > 1 else terms.collect()
        lists = [[t.encode("utf-8", "surrogatepass") for t in r["terms"]] for r in rows]
        index = index or LexicalIndex(docs, frozenset(chain.from_iterable(lists)) if parts == 1 else None)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item bigint, item_id {dict(items.dtypes)['item_id']}")
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = index.search(index.weighted(lists)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op13_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERM}')"
ORACLE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
    total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
    wanted AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
    lengths AS (SELECT r, doc_id, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM docs, total WHERE len(terms) > 0),
    scored AS (SELECT item_id, doc_id, r, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r) GROUP BY item_id, doc_id, r),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= {TOP}"""
