"""Training of a linear chain: scores of label pairs (and of first labels) from tagged sequences.

Tasks hold sequences and return, by Arrow batch, the gradient of their log likelihood: what was seen less what the chain
expects.  Spark sums; a round brings labels x (labels + 1) numbers to the driver, however many sequences there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.sources.storage import written

CELLS = 1 << 18  # steps x labels x labels of sequences that are computed together


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(emissions: np.ndarray, gold: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The log likelihood of sequences of one length (n x steps x labels, n x steps) and its gradient.
    ``weights`` has a row of scores for each label before, and one for the start."""
    n, steps, labels = emissions.shape
    pair, start = weights[:-1], weights[-1]
    each, grad = np.arange(n), np.zeros_like(weights)
    forward = np.empty_like(emissions)
    forward[:, 0] = start + emissions[:, 0]
    for t in range(1, steps):
        forward[:, t] = _logsum(forward[:, t - 1, :, None] + pair, 1) + emissions[:, t]
    z = _logsum(forward[:, -1], 1)
    seen = start[gold[:, 0]] + emissions[each, 0, gold[:, 0]]
    np.add.at(grad[-1], gold[:, 0], 1.0)
    after = np.zeros((n, labels))  # the log of all that follows a step
    for t in range(steps - 1, 0, -1):
        ahead = emissions[:, t] + after
        grad[:-1] -= np.exp(forward[:, t - 1, :, None] + pair + ahead[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(grad, (gold[:, t - 1], gold[:, t]), 1.0)
        seen = seen + pair[gold[:, t - 1], gold[:, t]] + emissions[each, t, gold[:, t]]
        after = _logsum(pair + ahead[:, None, :], 2)
    grad[-1] -= np.exp(start + emissions[:, 0] + after - z[:, None]).sum(0)
    return float((seen - z).sum()), grad


def _summed(sequences: DataFrame, emissions: str, gold: str, weights: np.ndarray) -> tuple[float, np.ndarray]:
    labels = weights.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, grad = 0.0, np.zeros_like(weights)
            for steps, rows in batch.groupby(batch[gold].map(len)):
                most = max(1, CELLS // (steps * labels))
                for i in range(0, len(rows), most):
                    e = np.array([[*map(list, s)] for s in rows[emissions].iloc[i : i + most]], float).reshape(-1, steps, labels)
                    ll, g = likelihood(e, np.stack(rows[gold].iloc[i : i + most].tolist()).astype(int), weights)
                    total, grad = total + ll, grad + g
            yield pd.DataFrame({"g": [[total, *grad.ravel().tolist()]]})

    parts = sequences.select(emissions, gold).mapInPandas(run, "g array<double>")
    rows = parts.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + weights.size)
    for k, v in rows:
        flat[k] = v
    return float(flat[0]), flat[1:].reshape(weights.shape)


@dataclass(frozen=True)
class Chain:
    """``weights``: labels + 1 rows (the last one for the start); ``history``: the objective after each accepted step."""

    weights: np.ndarray
    history: list[float]

    @property
    def transitions(self) -> np.ndarray:
        return self.weights[:-1]

    def started(self, emissions: Column) -> Column:
        """Emissions whose first step holds the scores of the start too, as ``sequence.decode`` takes them."""
        start = F.array(*[F.lit(float(x)) for x in self.weights[-1]])
        return F.transform(emissions, lambda e, i: F.when(i == 0, F.zip_with(e, start, lambda a, b: a + b)).otherwise(e))


def fit(sequences: DataFrame, emissions: str, gold: str, labels: int, rounds: int = 20, prior: float = 1.0) -> Chain:
    """Weights of largest likelihood under a Gaussian prior of weight ``prior``.

    The objective is concave: a step along the mean gradient that raises it is taken and the next one is longer, another is halved,
    so it never falls.  A round is one pass over the sequences, which are written to the shared folder once.  Sequences that are
    null or empty, or whose lists differ in length or hold nulls, take no part; with none at all the weights are zero."""
    good = (F.size(emissions) > 0) & (F.size(emissions) == F.size(gold)) & ~F.exists(gold, lambda g: g.isNull())
    sequences = written(sequences.select(F.col(emissions).cast("array<array<double>>").alias(emissions), gold).where(good))
    weights, history = np.zeros((labels + 1, labels)), []
    steps = sequences.agg(F.sum(F.size(gold))).first()[0]
    if not steps:
        return Chain(weights, history)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        ll, g = _summed(sequences, emissions, gold, w)
        return ll - prior * float((w * w).sum()) / 2, g - prior * w

    value, grad = objective(weights)
    history.append(value)
    rate = 4.0 / steps
    for _ in range(rounds):
        tried = weights + rate * grad
        new, slope = objective(tried)
        if new > value:
            weights, value, grad, rate = tried, new, slope, rate * 1.6
            history.append(value)
        else:
            rate /= 2
    return Chain(weights, history)
