"""Language identification by a byte convolutional network, trained in numpy.

A text's bytes (ASCII letters lower-cased) are cut into windows of fixed length, the last
one padded.  Bytes are embedded, filters of several widths run over each window, each
filter keeps its largest value, and a softmax layer gives the window's posteriors.  A
text's posteriors are those of all its windows, weighted by their bytes.

The network is fitted on a bounded sample: at most `sample_texts` labelled texts (those
of least hash of the id), of each at most `sample_windows` windows.  Everything else runs
over whole texts in Spark tasks, window batches of bounded size at a time.

Defined results: null texts and texts without a letter are `und` with score 0; without
any labelled text all are `und`; rows whose language is null are never learnt from;
repeated rows get equal results; other columns pass through `identify` unless they have
the name of a result column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import encode, remainder, small_batches, table

WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
WINDOW = 128
BATCH = 256
UNKNOWN = "und"


def windows_of(text: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes, the last padded by zeros; none for an empty text."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    n = -(-len(raw) // WINDOW)
    return np.pad(raw, (0, n * WINDOW - len(raw))).reshape(n, WINDOW)


class ByteCnn:
    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        width = FILTERS * len(WIDTHS)
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            **{f"conv{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS},
            "bias": np.zeros(width, np.float32),
            "out": rng.normal(0, 1 / np.sqrt(width), (width, len(labels))).astype(np.float32),
            "out_bias": np.zeros(len(labels), np.float32),
        }

    def tables(self) -> list[np.ndarray]:
        """For each offset in a filter: what a byte there adds to the filters that reach it."""
        e = self.params["embed"]
        return [np.concatenate([e @ self.params[f"conv{w}"][k] for w in WIDTHS if w > k], axis=1) for k in range(max(WIDTHS))]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each window; where it was if tables is None (training)."""
        learn, tables = tables is None, tables or self.tables()
        span = WINDOW - max(WIDTHS) + 1
        total = np.take(tables[0], x[:, :span], axis=0)
        for k in range(1, len(tables)):
            total[:, :, -tables[k].shape[1] :] += np.take(tables[k], x[:, k : k + span], axis=0)
        if learn:
            at = total.argmax(axis=1)
            return np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :], at
        return total.max(axis=1), None

    def posteriors(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), BATCH):
            hidden = np.maximum(self.pooled(x[i : i + BATCH], tables)[0] + self.params["bias"], 0)
            z = hidden @ self.params["out"] + self.params["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + BATCH] = z / z.sum(axis=1, keepdims=True)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(x)
        top, at = self.pooled(x)
        hidden = np.maximum(top + p["bias"], 0)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        back = (z @ p["out"].T) * (hidden > 0)
        g = {"out": hidden.T @ z, "out_bias": z.sum(axis=0), "bias": back.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            b, conv = back[:, own], p[f"conv{w}"]
            g[f"conv{w}"] = np.empty_like(conv)
            for k in range(w):  # only the place of the largest value has a gradient
                bytes_at = x[rows, at[:, own] + k]
                g[f"conv{w}"][k] = np.einsum("nfe,nf->ef", p["embed"][bytes_at], b)
                np.add.at(g["embed"], bytes_at, b[:, :, None] * conv[k].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.004, seed: int = 4) -> ByteCnn:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(x) for k, x in self.params.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                part = order[i : i + 128]
                step += 1
                for k, g in self._gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    near = rate * (1 - epoch / epochs) / (1 - 0.9**step)
                    self.params[k] -= near * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self


def train(labelled: DataFrame, sample_texts: int = 4000, sample_windows: int = 3) -> ByteCnn | None:
    """Fit on labelled (doc_id, text, lang) rows; None if there are none."""
    seed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(1))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", seed.alias("seed"))
    # the ids are chosen before any text is read
    last = rows.select("seed").orderBy("seed").limit(sample_texts).agg(F.max("seed").alias("m")).first()["m"]
    if last is None:
        return None

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                x = windows_of(encode(text.as_py()))
                rng = np.random.default_rng(own.as_py() & 0xFFFFFFFF)
                out += [(own.as_py(), w.tobytes(), lang.as_py()) for w in x[rng.permutation(len(x))[:sample_windows]]]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string())], ["seed", "window", "lang"])

    # equal seeds (repeated ids) could exceed the sample, so the bound is set again
    chosen = rows.where(F.col("seed") <= last).mapInArrow(pick, "seed long, window binary, lang string").orderBy("seed", "lang", "window").limit(sample_texts * sample_windows).toPandas()
    if not len(chosen):
        return None
    chosen = chosen.sort_values(["lang", "window"])
    labels = sorted(set(chosen["lang"]))
    x = np.frombuffer(b"".join(chosen["window"]), np.uint8).reshape(-1, WINDOW)
    return ByteCnn(labels).fit(x, np.array([labels.index(s) for s in chosen["lang"]]))


def _predict(model: ByteCnn, texts: list[str | None], tables: list[np.ndarray]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    live, parts = [], []
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            live.append(i)
            parts.append(encode(text))
    if live:
        x = [windows_of(p) for p in parts]
        post = model.posteriors(np.concatenate(x), tables)
        at = np.concatenate([[0], np.cumsum([len(w) for w in x])])
        weight = np.full(len(post), WINDOW, np.float64)
        weight[at[1:] - 1] = [(len(p) - 1) % WINDOW + 1 for p in parts]
        total = np.add.reduceat(post * weight[:, None], at[:-1], axis=0) / np.add.reduceat(weight, at[:-1])[:, None]
        for i, row in zip(live, total, strict=True):
            names[i], scores[i] = model.labels[int(row.argmax())], min(1.0, float(row.max()))
    return names, scores


def identify(documents: DataFrame, learn: Column, keep_text: bool = True) -> DataFrame:
    """documents plus lang_pred and score, learnt from the rows where `learn` holds.

    The text column is left out unless keep_text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    model = train(documents.where(learn).select("doc_id", "text", "lang"))
    docs = documents.drop("lang_pred", "score")
    if model is None:
        out = docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
        return out if keep_text else out.drop("text")
    shared = spark.sparkContext.broadcast(model)
    text_at, keep = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if keep_text or c != "text"]
    schema = T.StructType([docs.schema.fields[i] for i in keep]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                names, scores = _predict(model, batch.column(text_at).to_pylist(), tables)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return identify(docs, ~held_out, keep_text=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
