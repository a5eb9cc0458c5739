"""Evaluation: classification, sequences, spans, perplexity, regression, token matching.

All are groupings over rows of predictions and references; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as V

IGNORED = -100


def class_counts(rows: DataFrame, prediction: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """``label``, ``tp``, ``n_pred``, ``n_ref`` of every class, by ``keys``; counted before the shuffle."""
    pairs = rows.groupBy(*keys, prediction, reference).agg(F.count("*").alias("n"))
    hit = F.col(prediction) == F.col(reference)
    sides = F.array(
        F.struct(F.col(prediction).alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("n_pred"), F.lit(0).cast("long").alias("n_ref")),
        F.struct(F.col(reference).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n_pred"), F.col("n").alias("n_ref")),
    )
    out = pairs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return out.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_ref")])


def _rates() -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of a class; 0 where undefined."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("n_ref")), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def classification(rows: DataFrame, prediction: str, reference: str, average: str, keys: Sequence[str] = ()) -> DataFrame:
    """``accuracy``, ``precision``, ``recall``, ``f1`` with weighted or macro averages."""
    counts = class_counts(rows, prediction, reference, keys)
    weight = F.col("n_ref") if average == "weighted" else F.lit(1)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c * weight), F.sum(weight)), F.lit(0.0))
    p, r, f = _rates()
    return counts.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_ref")), F.lit(0.0)).alias("accuracy"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1")
    )


def token_rows(rows: DataFrame, predictions: str, references: str, *keep: str) -> DataFrame:
    """A row per token, without those whose reference is ignored."""
    zipped = F.arrays_zip(F.col(predictions).alias("p"), F.col(references).alias("r"))
    return rows.select(*keep, F.explode(zipped).alias("x")).select(*keep, F.col("x.p").alias("p"), F.col("x.r").alias("r")).where(F.col("r") != IGNORED)


def bio_spans(rows: DataFrame, keys: Sequence[str], pos: str, label: str) -> DataFrame:
    """``keys``, ``type``, ``first``, ``last`` of strict IOB2 spans: B begins one, I of the same type
    right after continues it; also a span of one token at the end counts."""
    by = Window.partitionBy(*keys).orderBy(pos)
    kind, name = F.substring(label, 1, 1), F.substring(label, 3, 1000)
    before, at = F.lag(label).over(by), F.lag(pos).over(by)
    follows = (kind == "I") & F.coalesce(F.substring(before, 3, 1000) == name, F.lit(False)) & F.coalesce(before != "O", F.lit(False)) & F.coalesce(at == F.col(pos) - 1, F.lit(False))
    marked = rows.select(*keys, pos, kind.alias("_k"), name.alias("type"), follows.alias("_f"))
    marked = marked.withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(by)).where("_k <> 'O'")
    spans = marked.groupBy(*keys, "_g").agg(F.min_by("_k", pos).alias("_k"), F.min_by("type", pos).alias("type"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    return spans.where("_k = 'B'").select(*keys, "type", "first", "last")


def span_scores(predicted: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 of exact spans."""
    on = [*keys, "type", "first", "last"]
    both = predicted.select(*on, F.lit(1).alias("n_pred"), F.lit(0).alias("n_ref")).unionByName(reference.select(*on, F.lit(0).alias("n_pred"), F.lit(1).alias("n_ref")))
    one = both.groupBy(*on).agg(F.max("n_pred").alias("n_pred"), F.max("n_ref").alias("n_ref")).withColumn("tp", F.col("n_pred") * F.col("n_ref"))
    total = one.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_pred", "n_ref")])
    p, r, f = _rates()
    return total.select("tp", "n_pred", "n_ref", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def perplexity(logits: Column, target: Column) -> Column:
    """The exponential of an aggregate: use inside ``agg``; ignored targets are rows to leave out."""
    return F.exp(F.avg(-F.get(V.log_softmax(logits), target.cast("int"))))


def greedy_match(pairs: DataFrame, key: str, base: float) -> DataFrame:
    """Token matching: each side's best cosine, rescaled by ``base`` and weighted.
    ``pairs``: ``ref``, ``cand``, ``cos``, ``ref_w``, ``cand_w``."""
    scaled = lambda c: (c - base) / (1 - base)

    def side(token: str, weight: str, name: str) -> DataFrame:
        best = pairs.groupBy(key, token).agg(F.max("cos").alias("m"), F.max(weight).alias("w"))
        return best.groupBy(key).agg((F.sum(scaled(F.col("m")) * F.col("w")) / F.sum("w")).alias(name))

    both = side("cand", "cand_w", "prec").join(side("ref", "ref_w", "rec"), key)
    return both.withColumn("f1", F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def label_smoothing_loss(logits: Column, target: Column, *, classes: int, smoothing: float, padding: int) -> Column:
    """KL divergence to a target that keeps ``1 - smoothing`` and spreads the rest over the other classes but padding."""
    rest = smoothing / (classes - 2)
    logp = V.log_softmax(logits)
    share = lambda i: F.when(i == padding, 0.0).when(i == target, 1 - smoothing).otherwise(rest)
    terms = F.transform(logp, lambda x, i: F.when(i == padding, 0.0).otherwise(share(i) * (F.log(F.greatest(share(i), F.lit(1e-300))) - x)))
    return F.when(target == padding, 0.0).otherwise(V.total(terms))


def aggregated(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """``score``: the weighted mean over all weighted tasks; a task without a score counts as 0."""
    rows = weights.join(scores, "task", "left")
    return rows.agg(F.try_divide(F.sum(F.coalesce("score", F.lit(0.0)) * F.col("weight")), F.sum("weight")).alias("score"))


def mse(rows: DataFrame, prediction: str, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    """The mean squared error and ``n`` of each key, over rows with both values."""
    gap = F.col(prediction).cast("double") - F.col(reference)
    return rows.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"), F.count(gap).alias("n"))


def tagged_spans(rows: DataFrame, keys: Sequence[str], predictions: str, references: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Predicted and reference spans of rows that hold a list of class ids each; ignored references are left out of both."""
    label = F.array(*[F.lit(n) for n in names])
    zipped = F.filter(F.arrays_zip(F.col(predictions).alias("p"), F.col(references).alias("r")), lambda x: x["r"] != IGNORED)
    tokens = rows.select(*keys, F.posexplode(zipped).alias("_pos", "_x"))
    side = lambda c: bio_spans(tokens.select(*keys, "_pos", F.get(label, F.col(f"_x.{c}").cast("int")).alias("_l")), keys, "_pos", "_l")
    return side("p"), side("r")


def evaluated(rows: DataFrame, task_type: str, *, predictions: str = "predictions", references: str = "labels", names: Sequence[str] = (), key: str = "id") -> DataFrame:
    """The metrics of a task type from what its model gives: class tasks and language models a list of logits a row, token
    classification a list of such lists (``names`` of the classes, ``key`` of the row), regression a number."""
    metric = metric_for(task_type)
    if metric == "mse":
        return mse(rows, predictions, references)
    if metric == "perplexity":
        return rows.where(F.col(references) != IGNORED).agg(perplexity(F.col(predictions), F.col(references)).alias("perplexity"))
    if metric == "span_scores":
        best = rows.select(key, F.transform(predictions, lambda v: V.argmax(v)).alias("_p"), F.col(references).alias("_r"))
        return span_scores(*tagged_spans(best, [key], "_p", "_r", names), [key])
    return classification(rows.select(V.argmax(F.col(predictions)).alias("_p"), F.col(references).cast("long").alias("_r")), "_p", "_r", "weighted")


METRICS = {
    "token_classification": "span_scores",
    "sequence_classification": "classification",
    "causal_lm": "perplexity",
    "seq2seq_lm": "perplexity",
    "inverse_cloze": "classification",
    "regression": "mse",
}


def metric_for(task_type: str) -> str:
    """The metric of a task type; unknown types raise."""
    if task_type not in METRICS:
        raise ValueError(f"no metric for task type {task_type!r}")
    return METRICS[task_type]
