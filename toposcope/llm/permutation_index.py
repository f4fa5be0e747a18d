"""Nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  It is posted in the inverted
files of its POST nearest pivots.  A query visits only the files of its VISIT nearest
pivots, ranks their vectors by footrule distance of the pivot orders (ranks beyond the
nearest half count alike), and reranks the best tenth of each file, at least RERANK_LEAST
and all that tie with the last of them, by exact cosine in double precision.  A vector
that is posted in several visited files is looked at in the first of them alone.

All vectors are indexed; only the pivots come from a bounded sample, and they are the one
thing that is sent to all tasks.  There are as many as the square root of the rows, 256 at
least and MOST_PIVOTS at most, so a file grows slower than the table.  A file is a group
of a shuffle: long files are split into segments of SEGMENT rows and their queries into
blocks of QUERY_BLOCK, so a pivot that is near to a third of all rows is split too.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows with a null id, take no part; ties go to the smaller id; an id that occurs twice is
two candidates, and two queries with a list each; a row whose id equals the query's is
never its neighbour; other columns are not read; with fewer candidates found than k, all
of them are returned; a table of up to 8 * VISIT rows has VISIT pivots, so that a query
visits every file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import scratch, stash, table

LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
SAMPLE = 16_384
#: on random vectors of 64 dimensions, the worst case, recall at 5 is about 0.95
POST, VISIT = 8, 24
RERANK_SHARE = 0.1
RERANK_LEAST = 64
SEGMENT = 8192
QUERY_BLOCK = 4096
RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query long, query_id long, row long, vec_id long, score double"


def _usable(c: Column) -> Column:
    wide = F.transform(c, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components survive."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def choose_pivots(vectors: DataFrame, pivots: int, sample: int = SAMPLE) -> np.ndarray | None:
    """Pivots far from one another, among at most `sample` vectors of least hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toPandas()
    if not len(rows):
        return None
    x = np.unique(_unit(_matrix(rows["embedding"])), axis=0)
    chosen, far = [0], 1 - x @ x[0]
    rng = np.random.default_rng(10)
    while len(chosen) < min(pivots, len(x)):
        weight = np.maximum(far, 0) ** 2
        if weight.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return x[chosen]


def permutations(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """All pivots of each row, the nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")


def ranks(orders: np.ndarray) -> np.ndarray:
    """Rank of each pivot in each row's order; those beyond the nearest half count alike."""
    n, pivots = orders.shape
    out = np.empty((n, pivots), dtype=np.int16)
    np.put_along_axis(out, orders, np.arange(pivots, dtype=np.int16)[None, :], axis=1)
    return np.minimum(out, -(-pivots // 2))


def footrule(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Distance of one row of ranks to many."""
    return np.abs(many - one).sum(axis=1, dtype=np.int64)


def _post_task(pivots: np.ndarray, near: int):
    def post(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                orders = permutations(_unit(_matrix(pdf["embedding"])), pivots)[:, :near]
                yield pdf.assign(near=list(orders.astype(np.int32)))

    return post


def _search_task(pivots: np.ndarray, post: int, share: float, k: int):
    def search(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            pivot = key[0]
            x, ids, row = _unit(_matrix(rows["embedding"])), rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            orders = permutations(x, pivots)
            posted, places = orders[:, :post], ranks(orders)
            q, own, query = _unit(_matrix(queries["asked"])), queries["query_id"].to_numpy(), queries["query"].to_numpy()
            q_orders = permutations(q, pivots)
            q_places = ranks(q_orders)
            for i, order in enumerate(q_orders):
                before = np.zeros(len(pivots), dtype=bool)
                before[order[: int(np.flatnonzero(order == pivot)[0])]] = True
                here = np.flatnonzero(~before[posted].any(axis=1) & (ids != own[i]))
                if not len(here):
                    continue
                distance = footrule(q_places[i], places[here])
                rerank = min(len(here), max(RERANK_LEAST, k, round(share * len(here))))
                here = here[distance <= np.partition(distance, rerank - 1)[rerank - 1]]
                cosine = (x[here] * q[i]).sum(axis=1)
                best = np.lexsort((ids[here], -cosine))[:k]
                found += [(int(query[i]), int(own[i]), int(row[here[b]]), int(ids[here[b]]), float(cosine[b])) for b in best]
        return pd.DataFrame(found, columns=["query", "query_id", "row", "vec_id", "score"])

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, post: int = POST, visit: int = VISIT, share: float = RERANK_SHARE, path: str | None = None) -> DataFrame:
    """The k nearest rows of each row for which is_query holds, by cosine."""
    spark = vectors.sparkSession
    path = path or scratch(spark)
    usable = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stash(usable.withColumn("row", F.monotonically_increasing_id()), f"{path}/rows")  # numbers are fixed once written
    n = rows.count()
    centres = choose_pivots(rows.select("vec_id", "embedding"), pivots or max(visit, min(MOST_PIVOTS, n // 8, max(LEAST_PIVOTS, int(n**0.5)))))
    if centres is None:
        return spark.createDataFrame([], RESULT)
    post, visit = min(post, len(centres)), min(visit, len(centres))
    posted = stash(rows.mapInPandas(_post_task(centres, max(post, visit)), T.StructType([*rows.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])), f"{path}/posted")
    held = posted.select("row", "vec_id", "embedding", F.explode(F.slice("near", 1, post)).alias("pivot"))
    asked = posted.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), F.explode(F.slice("near", 1, visit)).alias("pivot"))
    # at most MOST_PIVOTS rows
    files = held.groupBy("pivot").agg(F.count("*").alias("rows")).join(asked.groupBy("pivot").agg(F.count("*").alias("queries")), "pivot")
    files = F.broadcast(files.select("pivot", F.ceil(F.col("rows") / SEGMENT).cast("int").alias("segments"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("blocks")))
    held = held.join(files, "pivot").select("row", "vec_id", "embedding", "pivot", F.pmod(F.xxhash64("row"), "segments").cast("int").alias("segment"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.join(files, "pivot").select("query", "query_id", "asked", "pivot", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"), F.pmod(F.xxhash64("query"), "blocks").cast("int").alias("block"))
    key = ("pivot", "segment", "block")
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_search_task(centres, post, share, k), FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
