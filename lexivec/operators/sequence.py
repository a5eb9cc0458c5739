"""Label lattices and logits filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> tuple[list[int], float]:
    """The best path through a lattice (steps x labels); ties go to the lower label."""
    score, back = emissions[0], []
    for e in emissions[1:]:
        step = score[:, None] + transitions
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def forward_score(emissions: np.ndarray, transitions: np.ndarray) -> float:
    """The log of the sum over all paths."""
    score = emissions[0]
    for e in emissions[1:]:
        step = score[:, None] + transitions
        top = step.max(0)
        score = top + np.log(np.exp(step - top).sum(0)) + e
    top = score.max()
    return float(top + np.log(np.exp(score - top).sum()))


def decode(sequences: DataFrame, key: str, emissions: str, transitions: np.ndarray) -> DataFrame:
    """``key``, ``path``, ``score``, ``log_z`` for a column of step-wise label scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, steps in zip(batch[key], batch[emissions], strict=True):
                e = np.stack(list(steps)).astype(float)
                out.append((k, *viterbi(e, transitions), forward_score(e, transitions)))
            yield pd.DataFrame(out, columns=[key, "path", "score", "log_z"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.where(F.size(emissions) > 0).select(key, emissions).mapInPandas(run, f"{key} {kind}, path array<int>, score double, log_z double")


def filtered_logits(rows: DataFrame, key: str, logits: str, *, top_k: int, top_p: float, temperature: float = 1.0, min_keep: int = 1) -> DataFrame:
    """``key``, ``token``, ``logit`` that temperature, top-k and top-p leave, largest first (a row is one vocabulary)."""
    flat = rows.select(key, F.posexplode(logits).alias("token", "logit")).withColumn("logit", F.col("logit").cast("double") / temperature)
    by = Window.partitionBy(key).orderBy(F.desc("logit"), "token")
    kept = flat.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(top_k, min_keep))
    top = F.max("logit").over(Window.partitionBy(key))
    p = F.exp(F.col("logit") - F.col("_top"))
    kept = kept.withColumn("_top", top).withColumn("_p", p / F.sum(p).over(Window.partitionBy(key)))
    before = F.coalesce(F.sum("_p").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return kept.withColumn("_before", before).where((F.col("_before") < top_p) | (F.col("rank") <= min_keep)).select(key, "token", "rank", "logit")


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    """Tokens that occurred lose: positive scores are divided, negative multiplied."""
    return F.when(seen, F.when(logit < 0, logit * penalty).otherwise(logit / penalty)).otherwise(logit)
