"""Sentence windows around a mention, within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+|\n|$)\s*")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Half-open spans of sentences, white space at their ends left out."""
    out = []
    for m in _SENTENCE.finditer(text):
        own = m.group()
        if own.strip():
            start = m.start() + len(own) - len(own.lstrip())
            out.append((start, start + len(own.strip())))
    return out


def window(costs: list[int], target: int, budget: int) -> tuple[int, int]:
    """First and last sentence: grown by one before and one after in turn while the budget holds.

    The target stays even if it alone is over the budget; a side that does not fit or
    has ended is closed.
    """
    if not 0 <= target < len(costs):
        raise ValueError("target is not a sentence")
    first = last = target
    total = costs[target]
    before, after = True, True
    while before or after:
        if before:
            before = first > 0 and total + costs[first - 1] <= budget
            if before:
                first -= 1
                total += costs[first]
        if after:
            after = last + 1 < len(costs) and total + costs[last + 1] <= budget
            if after:
                last += 1
                total += costs[last]
    return first, last


def context_of(text: str, start: int, end: int, budget: int, cost: Callable[[str], int] = lambda s: len(s.split())) -> str:
    """The whole text if it fits in the budget, else the window of sentences around the span."""
    if cost(text) <= budget:
        return text
    spans = split_sentences(text)
    at = [i for i, (a, b) in enumerate(spans) if a <= start < b]
    if not at:
        raise ValueError("the span lies in no sentence")
    first, last = window([cost(text[a:b]) for a, b in spans], at[0], budget)
    return " ".join(text[a:b] for a, b in spans[first : last + 1])


def context_window(budget: int):
    """A pandas function (text, start, end) -> context."""

    @F.pandas_udf(T.StringType())
    def contexts(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([context_of(t, int(s), int(e), budget) if t is not None else None for t, s, e in zip(text, start, end, strict=True)], dtype=object)

    return contexts
