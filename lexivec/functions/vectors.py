"""Vector and sequence functions on arrays as Column expressions.  Sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def with_each(v: Column, value: Column, f) -> Column:
    """``f(x, value)`` for every x of v.  The value is evaluated once, which a lambda that captured it would not do."""
    return F.zip_with(v, F.array_repeat(value, F.size(v)), f)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(v: Column) -> Column:
    return with_each(doubles(v), norm(v), lambda x, n: F.try_divide(x, n))


def padded(v: Column, size: int | Column) -> Column:
    """Zeros up to ``size``; longer lists stay."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(size - F.size(v), F.lit(0))))


def argmax(v: Column) -> Column:
    """The place, from 0, of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def first_zero(ids: Column) -> Column:
    """The place of the first 0, else the size."""
    at = F.array_position(ids, 0)
    return F.when(at > 0, at - 1).otherwise(F.size(ids).cast("long"))


def zero_places(ids: Column) -> Column:
    """The places from the first zero on."""
    return F.filter(F.transform(ids, lambda x, i: F.when(i >= first_zero(ids), i)), lambda i: i.isNotNull())


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(doubles(v))
    top = F.when(top == float("-inf"), 0.0).otherwise(top)
    return top + F.log(total(with_each(doubles(v), top, lambda x, t: F.exp(x - t))))


def log_softmax(v: Column) -> Column:
    return with_each(doubles(v), log_sum_exp(v), lambda x, w: x - w)


def softmax(v: Column) -> Column:
    return F.transform(log_softmax(v), lambda x: F.exp(x))


def multi_hot(ids: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.array_contains(ids, i), 1.0).otherwise(0.0))


def masked_mean(vectors: Column, mask: Column, width: int, denominator: str = "mask") -> Column:
    """The mean of masked vectors; by ``width``: over all places, as remote pooling does."""
    pairs = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    zero = F.array_repeat(F.lit(0.0), width)
    added = F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, doubles(p["v"]), lambda x, y: x + y * p["m"].cast("double")))
    size = F.greatest(total(mask.cast("array<double>")), F.lit(1e-9)) if denominator == "mask" else F.size(mask).cast("double")
    return with_each(added, size, lambda x, n: x / n)


def zero_filled(vectors: Column, length: Column, width: int) -> Column:
    """Hidden states with zeros from place ``length`` on."""
    return F.transform(vectors, lambda v, i: F.when(i >= length, F.array_repeat(F.lit(0.0), width)).otherwise(doubles(v)))


def decayed_rate(rate: float, decay: float, epoch: Column) -> Column:
    return F.lit(rate) / (1 + F.lit(decay) * (epoch - 1))


def warmup_rate(unit: float, warmup: int, step: Column, power: float = 0.98) -> Column:
    """Grows by ``unit`` a step until ``warmup``, then falls with a power of the step."""
    step = step.cast("double")
    return F.when(step < warmup, step * unit).otherwise(F.lit(unit * warmup) * F.pow(step / warmup, F.lit(-power)))
