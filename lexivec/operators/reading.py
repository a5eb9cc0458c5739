"""Span reading: linear heads over hidden states, best spans of a passage, and the answers of a query's passages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as V

SPANS = "array<struct<start:int,end:int,score:double>>"


def head(state: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """One output of a linear layer over a hidden state."""
    return V.dot(state, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def projected(state: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] = ()) -> Column:
    """A linear layer: one row of weights for each place of the result."""
    bias = bias or [0.0] * len(weights)
    return F.array(*[head(state, w, b) for w, b in zip(weights, bias, strict=True)])


def head_logits(states: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """A head's output at every step."""
    return F.transform(states, lambda s: head(s, weights, bias))


def sliding_argmax(x: np.ndarray, width: int) -> np.ndarray:
    """For each place the first of the largest among itself and the ``width - 1`` places before it, by prefix maxima
    of blocks from both sides: a few passes whatever the width."""
    n = len(x)
    width = max(1, min(width, n))
    blocks = -(-(n + width - 1) // width)
    y = np.full(blocks * width, -np.inf)
    y[width - 1 : width - 1 + n] = x
    y = y.reshape(-1, width)
    place = np.arange(y.size).reshape(-1, width)
    left = np.maximum.accumulate(y, axis=1)
    left_at = np.maximum.accumulate(np.where(np.c_[np.ones(len(y), bool), y[:, 1:] > left[:, :-1]], place, 0), axis=1)
    back = y[:, ::-1]
    right = np.maximum.accumulate(back, axis=1)
    newer = np.c_[np.ones(len(y), bool), back[:, 1:] >= right[:, :-1]]
    step = np.maximum.accumulate(np.where(newer, np.arange(width), 0), axis=1)
    right_at = (place[:, -1:] - step)[:, ::-1].ravel()
    right, left, left_at = right[:, ::-1].ravel(), left.ravel(), left_at.ravel()
    begin = np.arange(n)
    end = begin + width - 1
    at = np.where(right[begin] >= left[end], right_at[begin], left_at[end]) - (width - 1)
    return np.maximum(at, np.maximum(begin - width + 1, 0))


def top_spans(start: np.ndarray, end: np.ndarray, width: int, most: int) -> list[tuple[int, int, float]]:
    """The best spans of up to ``width`` steps, none of which overlap: start, end (inclusive) and score.

    What doesn't overlap the best span lies left or right of it, so each pick splits a stretch in two and looks at those only;
    ties go to the smaller start, then the smaller end."""

    def best(low: int, high: int) -> list[tuple[float, int, int, int, int]]:
        if low >= high:
            return []
        at = sliding_argmax(start[low:high], width)
        score = start[low:high][at] + end[low:high]
        j = int(np.lexsort([np.arange(len(at)), at, -score])[0])
        return [(-float(score[j]), low + int(at[j]), low + j, low, high)]

    open_, out = best(0, len(start)), []
    while open_ and len(out) < most:
        pick = min(open_)
        open_.remove(pick)
        score, i, j, low, high = pick
        out.append((i, j, -score))
        open_ += best(low, i) + best(j + 1, high)
    return out


def best_spans(start: Column, end: Column, *, width: int, most: int) -> Column:
    """``SPANS`` of arrays of start and end logits.  Null or empty arrays have no spans; of unequal ones the shorter counts; null or NaN logits can't be chosen."""

    def find(starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for s, e in zip(starts, ends, strict=True):
            if s is None or e is None:
                out.append([])
                continue
            n = min(len(s), len(e))
            s, e = (np.array([-np.inf if x is None or x != x else x for x in v[:n]], float) for v in (s, e))
            out.append([{"start": i, "end": j, "score": x} for i, j, x in top_spans(s, e, width, most) if x > -np.inf])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, SPANS)(start, end)


def answers(passages: DataFrame, *, query: str, passage: str, relevance: str, spans: str, most: int) -> DataFrame:
    """``query``, ``rank``, ``passage``, ``start``, ``end``, ``score``: the spans of a query's passages, the most relevant passage first
    (ties: the smaller), each passage's in their order; ``most`` of them a query."""
    rows = passages.select(F.col(query).alias("query"), F.col(passage).alias("passage"), F.col(relevance).alias("_r"), F.posexplode(spans).alias("_k", "s"))
    by = Window.partitionBy("query").orderBy(F.desc("_r"), "passage", "_k")
    ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return ranked.select("query", "rank", "passage", "s.start", "s.end", "s.score")
