import numpy as np
import pandas as pd
import pyarrow as pa

from toposcope.llm import bloom_lm as B
from toposcope.llm._shared import WordHashes


def test_requests_of_a_segment_are_answered_together(monkeypatch):
    texts = [f"w{i % 50} v{i % 7} u{i}" for i in range(300)]
    parts = pa.Table.from_batches(B._count_task(1)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))).to_pandas()
    built = B._build_task(1, B.FALSE_COUNT)(parts)
    split = pa.Table.from_batches(B._split_task(4.0, B.WORD_PROBES)(iter([pa.RecordBatch.from_pandas(built[["seg", "keys", "counts"]])]))).to_pandas()
    held = built[["seg", "keys", "counts", "pairs", "probes"]].merge(split[["seg", "words", "word_probes"]], on="seg")
    hashes, rows = WordHashes(), []
    for req, text in enumerate([*texts, "w1 unknown"]):
        h = B.tokens_of(text, hashes)
        words, pairs = np.unique(h), np.unique(B._pairs(h, np.zeros(1, np.int64)))
        rows += [(req, B.WORDS, 0, words.tobytes()), (req, B.PAIRS, 0, B._packed_keys(pairs))]
    asked = pd.DataFrame(rows, columns=["req", "kind", "seg", "payload"])
    one = pd.concat([B._answer_task(1, True)(asked.iloc[[i]], held) for i in range(len(asked))])
    calls, levels = [], B.Filters.levels
    monkeypatch.setattr(B.Filters, "levels", lambda self, kind, keys: (calls.append(kind), levels(self, kind, keys))[1])
    order = ["req", "kind"]
    got = B._answer_task(1, True)(asked, held)
    assert len(calls) == 2  # before: one for each of 602 requests
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), one.sort_values(order).reset_index(drop=True))
    # a bound on the bytes of requests makes more of them, with the same answers
    monkeypatch.setattr(B, "ANSWER_BYTES", 500)
    again = B._answer_task(1, True)(asked, held)
    assert len(calls) > 10
    pd.testing.assert_frame_equal(again.sort_values(order).reset_index(drop=True), got.sort_values(order).reset_index(drop=True))
    # nothing is known of the words of a segment that holds none
    none = B._answer_task(1, False)(asked, held.iloc[:0])
    assert set(none["levels"]) == {b""} and not any(any(c) for c in none["counts"])
