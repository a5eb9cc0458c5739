"""Goldens worked out by hand from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.functions import vectors as V
from lexivec.operators.scoring import bm25_weight


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v)
    return row.select(column).first()[0]


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


def floats(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_merge_pieces(spark):
    assert one(spark, X.merge_pieces(strings("un", "##real", "time", "##s"))) == ["unreal", "times"]
    assert one(spark, X.strip_piece_mark(F.lit("##x"))) == "x"


def test_ngrams_and_shingles(spark):
    assert one(spark, X.ngrams(strings("a", "b", "c"))) == ["a_b", "b_c"]
    assert one(spark, X.ngrams(strings("a"))) == []
    assert one(spark, X.shingles(strings("a", "b"), 5)) == ["a b"]


def test_digits_and_spaces(spark):
    assert one(spark, X.normalize_digits(F.lit("a1２")), ) == "a00"
    assert one(spark, X.number_runs(F.lit("a12b3"))) == "aNbN"
    assert one(spark, X.strip_format(F.lit("a​b­c"))) == "abc"
    assert one(spark, X.hangul_or_digit(F.lit("한1x  y"))) == "한1  "


def test_sentences(spark):
    parts = one(spark, X.split_sentences(F.lit("갔다.왔다.\n끝")))
    assert [p for p in parts if p] == ["갔다.", "왔다.", "끝"]
    assert one(spark, X.segments(F.lit("ab c  de "))) == ["ab", "de"]


def test_script_and_category(spark):
    assert [one(spark, X.script(F.lit(c))) for c in "aЖ한漢1"] == ["Latin", "Cyrillic", "Hangul", "Han", "Common"]
    assert [one(spark, X.category(F.lit(c))) for c in "aA1 ."] == ["Ll", "Lu", "Nd", "Zs", "Po"]


def test_quote_segment(spark):
    assert one(spark, X.quote_segment(F.lit("a b/c~d*"))) == "a%20b%2Fc~d%2A"


def test_first_zero(spark):
    ids = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, V.first_zero(ids(2, 5, 3, 0, 0))) == 3
    assert one(spark, V.first_zero(ids(2, 5, 3))) == 3
    assert one(spark, V.zero_places(ids(2, 5, 3, 0, 0))) == [3, 4]


def test_masked_mean(spark):
    h = F.array(floats(1, 1), floats(3, 3), floats(9, 9))
    m = F.array(F.lit(1), F.lit(1), F.lit(0))
    assert one(spark, V.masked_mean(h, m, 2)) == [2, 2]
    assert one(spark, V.masked_mean(h, m, 2, "width")) == pytest.approx([4 / 3, 4 / 3])
    assert one(spark, V.zero_filled(h, F.lit(1), 2)) == [[1, 1], [0, 0], [0, 0]]


def test_log_sum_exp_and_softmax(spark):
    assert one(spark, V.log_sum_exp(floats(0, 0))) == pytest.approx(math.log(2))
    assert one(spark, V.softmax(floats(1, 1, 1))) == pytest.approx([1 / 3] * 3)
    assert one(spark, V.log_sum_exp(floats(1000, 0))) == pytest.approx(1000)


def test_vectors(spark):
    assert one(spark, V.normalized(floats(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.cosine(floats(1, 0), floats(0, 0))) is None
    assert one(spark, V.padded(floats(1, 2), 4)) == [1, 2, 0, 0]
    assert one(spark, V.argmax(floats(1, 5, 5))) == 1
    assert one(spark, V.multi_hot(F.array(F.lit(1), F.lit(3)), 4)) == [0, 1, 0, 1]


def test_bm25(spark):
    w = bm25_weight(*[F.lit(float(x)) for x in (1, 7, 7, 10, 1)])
    assert one(spark, w) == pytest.approx(1 / 2.2 * math.log(1 + 9.5 / 1.5))


def test_rates(spark):
    assert one(spark, V.decayed_rate(0.1, 0.5, F.lit(3))) == pytest.approx(0.05)
    assert one(spark, V.warmup_rate(0.01, 10, F.lit(5))) == pytest.approx(0.05)
    assert one(spark, V.warmup_rate(0.01, 10, F.lit(10))) == pytest.approx(0.1)
    assert np.isclose(one(spark, V.warmup_rate(0.01, 10, F.lit(20))), 0.1 * 2**-0.98)
