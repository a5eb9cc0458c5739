"""Pluggable encoders and tokenizers, loaded once in a worker process and fed in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions import vectors as V


class Encoder(Protocol):
    """Texts to a float32 matrix."""

    width: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Signed counts of hashed words, of norm one: deterministic and without a model file."""

    width: int = 32

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                h = hashlib.md5(w.encode()).hexdigest()
                out[i, int(h[:8], 16) % self.width] += 1 if int(h[8], 16) < 8 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


@dataclass(frozen=True)
class EncoderSpec:
    """How to make an encoder on a worker, and how to feed it."""

    make: Callable[[], Encoder] = HashingEncoder
    batch_size: int = 256
    pool: str = "passthrough"


def encode(column: Column | str, spec: EncoderSpec) -> Column:
    """A column of ``array<float>``; null texts are encoded as empty ones."""

    def make_predict():
        encoder = spec.make()

        def predict(texts: np.ndarray) -> np.ndarray:
            return encoder([t or "" for t in texts.tolist()])

        return predict

    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=spec.batch_size)
    return udf(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


POOLINGS: dict[tuple[str, str], Callable[[Column, Column, int], Column]] = {
    (runtime, output): f
    for runtime in ("local", "traced", "remote")
    for output, f in {
        "last_hidden_state": lambda h, m, w: h,
        "cls": lambda h, m, w: F.get(h, F.lit(0)),
        "mean": (lambda h, m, w: V.masked_mean(h, m, w, "width")) if runtime == "remote" else (lambda h, m, w: V.masked_mean(h, m, w)),
        "zero_filled": lambda h, m, w: V.zero_filled(h, V.first_zero(m), w),
    }.items()
}


def pooling(runtime: str, output: str):
    if (runtime, output) not in POOLINGS:
        raise ValueError(f"no pooling for {runtime!r}, {output!r}")
    return POOLINGS[runtime, output]


def classified_tokens(rows: DataFrame, keys: list[str], tokens: str, starts: str, logits: str, labels: list[str]) -> DataFrame:
    """``keys``, ``pos``, ``token``, ``label``: the best label of every first piece of a word (offset 0)."""
    zipped = F.arrays_zip(F.col(tokens).alias("t"), F.col(starts).alias("o"), F.col(logits).alias("z"))
    names = F.array(*[F.lit(x) for x in labels])
    flat = rows.select(*keys, F.posexplode(zipped).alias("pos", "x")).where("x.o = 0")
    return flat.select(*keys, "pos", F.col("x.t").alias("token"), F.get(names, V.argmax(F.col("x.z")).cast("int")).alias("label"))


# Prefixes of class names, and the attribute under which such a model keeps its encoder.
FAMILIES = {"Bert": "bert", "Roberta": "roberta", "Albert": "albert", "Bart": "model", "Electra": "electra", "GPT2": "transformer"}


def family_attribute(class_name: Column, strict: bool = True) -> Column:
    """The attribute of the first family whose prefix the class name has; another name raises, or is null if not ``strict``; no name has none."""
    found = F.coalesce(*[F.when(F.startswith(class_name, F.lit(p)), F.lit(a)) for p, a in FAMILIES.items()])
    unknown = F.raise_error(F.concat(F.lit("no model family for "), class_name)).cast("string")
    return F.when(class_name.isNotNull(), F.coalesce(found, unknown)) if strict else found
