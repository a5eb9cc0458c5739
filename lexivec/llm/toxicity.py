"""Toxicity as an ordinal grade: a cumulative-link model over sparse word features.

``P(grade <= k) = sigmoid(theta_k - w.x)``: the ordered thresholds share one weight vector, so expected
severity ``sum_k P(grade > k)`` grows with evidence.  Features are the densities of words and stems (a word's first
``STEMS`` letters) that the labels single out: by the log likelihood ratio of document counts, in varied
surroundings, at most ``max_features``.

Labels say toxic or not; grades come from them and from how many independent judges agree: the sample falls into ``FOLDS`` by a
hash of the id, each fold trains a judge of its own, and a toxic row is 1, 2 or 3 by the number (one at least) of the judges
from other folds that call it toxic.  Rows that aren't toxic are 0.

The model is fitted on a bounded sample of labelled rows (``max_labelled``, by a hash of the id; rows of one
label whose texts are equal but for case and spaces are one witness).  Word counts
of the sample are Spark jobs; what reaches the driver is bounded by ``max_labelled`` and ``max_features``.  Every
text is scored whole.

Defined cases: a null text has no words and gets the model's score of no evidence; without labelled
rows of both kinds every severity is 0 and nothing is rejected; labels that repeat count as the highest; repeated rows
are scored each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.bpe import pieces
from lexivec.llm.common import written

FOLDS = 4
STEMS = (5, 6, 7)
SHORT = 100
WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass
class OrdinalModel:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    theta: np.ndarray = field(default_factory=lambda: np.full(3, 50.0))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """How many of a thousand words of the whole text match each of the model's words or stems;
        ``SHORT`` words are added to the length, so that one match says little in a very short text."""
        x = np.zeros((len(texts), len(self.words)))
        for i, t in enumerate(texts):
            words = WORDS((t or "").lower())
            for w, n in Counter(words).items():
                for key in (w, *(w[:k] + "*" for k in STEMS if len(w) >= k)):
                    if key in self.words:
                        x[i, self.words[key]] += 1000 * n / (len(words) + SHORT)
        return x

    def exceeds(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(np.clip(self.theta - (x @ self.weights)[:, None], -60, 60)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, *, ridge: float = 2e-5, steps: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of maximum penalised likelihood, by Adam on all rows."""
    w, first, gaps = np.zeros(x.shape[1]), np.zeros(1), np.zeros(grades - 2)
    params = [w, first, gaps]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        theta = first[0] + np.r_[0, np.cumsum(np.exp(gaps))]
        eta = x @ w
        cdf = 1 / (1 + np.exp(-(np.r_[-60.0, theta, 60.0][None] - eta[:, None]).clip(-60, 60)))
        rows = np.arange(len(x))
        low, high = cdf[rows, grade], cdf[rows, grade + 1]
        like = np.maximum(high - low, 1e-12)
        dlow, dhigh = low * (1 - low), high * (1 - high)
        deta = (dhigh - dlow) / like / len(x)  # of the negative log likelihood
        dtheta = np.zeros(grades + 1)
        np.add.at(dtheta, grade, dlow / like / len(x))
        np.add.at(dtheta, grade + 1, -dhigh / like / len(x))
        dtheta = dtheta[1:-1]
        grads = [x.T @ deta + ridge * w, dtheta.sum(keepdims=True), np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(gaps)]
        for p, g, (m, v) in zip(params, grads, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, first[0] + np.r_[0, np.cumsum(np.exp(gaps))]


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 8000, max_features: int = 256, min_docs: int = 5, min_score: float = 30.0) -> OrdinalModel:
    labelled = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    total = labelled.count()
    share = int(1e6 * max_labelled / max(total, 1)) + 1
    labelled = labelled.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < share)
    labelled = labelled.groupBy("id").agg(F.max("y").alias("y"))
    labelled = labelled.orderBy(F.xxhash64("id"), "id").limit(2 * max_labelled)  # so small enough to broadcast
    body = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    same = F.xxhash64(F.lower(F.regexp_replace("text", r"\s+", " ")))
    sample = body.join(F.broadcast(labelled), "id").groupBy(same.alias("same"), "y").agg(F.min(F.struct("id", "text")).alias("r"))
    sample = written(sample.select("r.id", "y", "r.text", F.pmod(F.xxhash64(F.col("r.id").cast("string"), F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")))
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return OrdinalModel()
    words = sample.select("id", "y", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1).alias("all"))
    words = words.select("id", "y", F.explode(F.transform("all", lambda w, i: F.struct(w.alias("w"), F.get("all", i - 1).alias("before")))).alias("p"))
    words = words.groupBy("id", F.col("p.w").alias("w")).agg(F.max("y").alias("y"), F.min("p.before").alias("before"))
    stems = [F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS]
    words = words.select("id", "y", "before", F.explode(F.array_compact(F.array("w", *stems))).alias("w"))
    words = words.groupBy("id", "w").agg(F.max("y").alias("y"), F.min("before").alias("before"))
    counts = words.groupBy("w").agg(
        F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"), F.count_distinct(F.when(F.col("y") == 1, F.col("before"))).alias("c")
    )
    # A word that toxic rows always have after the same word comes from passages that they share, not from what they mean.
    counts = counts.where((F.col("a") + F.col("b") >= min_docs) & (2 * F.col("c") >= F.col("a"))).withColumn("score", _likelihood_ratio(F.col("a"), F.col("b"), size[1], size[0]))
    best = counts.where(F.col("score") >= min_score).orderBy(F.desc("score"), "w").limit(max_features).collect()
    model = OrdinalModel({r.w: i for i, r in enumerate(best)}, np.zeros(len(best)))
    rows = [(r.fold, r.y, r.x) for r in _features(sample, model).toLocalIterator()]
    fold, y = (np.array([r[i] for r in rows]) for i in (0, 1))
    x = np.array([r[2] for r in rows]).reshape(len(rows), -1)
    grade = agreement(x, y, fold)
    model.weights, model.theta = fit_ordinal(x, grade, 4)
    return model


def agreement(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 where y is 0; else how many judges of other folds call the row toxic, from 1 to ``FOLDS`` - 1."""
    votes = np.zeros(len(y), int)
    for f in range(FOLDS):
        own = fold == f
        if len(set(y[own].tolist())) == 2:
            w, theta = fit_ordinal(x[own], y[own], 2)
            votes += ~own & (x @ w > theta[0])
    return np.where(y > 0, np.clip(votes, 1, FOLDS - 1), 0)


def _likelihood_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Dunning's statistic of a word's document counts in n1 toxic and n0 other rows."""
    share = (a + b) / (n1 + n0)
    term = lambda k, p: F.when(k > 0, k * F.log(k / p)).otherwise(0.0)
    return 2 * (term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0))


def _features(sample: DataFrame, model: OrdinalModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                x = model.features(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x.tolist(), pa.list_(pa.float64()))], ["fold", "y", "x"])

    return sample.select("fold", "y", "text").mapInArrow(run, "fold int, y int, x array<double>")


def score(docs: DataFrame, model: OrdinalModel, *, text: str = "text", keep: Sequence[str] = ("doc_id",), reject_from: float = 0.5) -> DataFrame:
    """``keep``, ``expected_severity``, ``grade`` (the most likely) and ``toxic`` (severity of ``reject_from`` or more)."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    added = [T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                above = model.exceeds(model.features(batch.column(batch.num_columns - 1).to_pylist()))
                severity = above.sum(1)
                p = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
                columns = [pa.array(severity), pa.array(p.argmax(1).astype(np.int32)), pa.array(severity >= reject_from)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "expected_severity", "grade", "toxic"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], *added]))
