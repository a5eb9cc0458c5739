"""Sentence runs, filled shards, chain training, samples: against plain versions."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import crf, labels, model, pretraining, relational, sequence


def plain_breaks(sizes, targets, splits, coins):
    out, i = [], 0
    while i < len(sizes):
        stop, n = i, 0
        while stop < len(sizes) and n < targets[i]:
            n, stop = n + sizes[stop], stop + 1
        split = 1 + splits[i] % (stop - i - 1) if stop - i > 1 else 1
        lone = stop - i == 1 or coins[i]
        out.append([i, split, stop, int(bool(lone))])
        i = i + split if lone else stop
    return out


def test_run_breaks_equal_a_walk():
    rng = random.Random(3)
    for _ in range(200):
        m = rng.randint(1, 60)
        row = [[rng.randint(1, 40) for _ in range(m)], [rng.randint(2, 90) for _ in range(m)], [rng.randint(0, 2**32) for _ in range(m)], [rng.randint(0, 1) for _ in range(m)]]
        assert pretraining.run_breaks(*[np.array(x) for x in row]) == plain_breaks(*row)


def test_sentence_runs_of_nulls_empty_and_long_documents(spark):
    long = [[f"w{i}", "x"] for i in range(20_000)]
    rows = [(1, None), (2, []), (3, [[], ["a"]]), (4, [["b", "c"], ["d"], ["e"]]), (5, long)]
    docs = spark.createDataFrame(rows, "d long, s array<array<string>>").withColumn("first", F.lit("clash")).withColumn("_i", F.lit(0))
    runs = pretraining.with_segments(pretraining.sentence_runs(docs, "d", "s", 64)).collect()
    assert {r.d for r in runs} == {3, 4, 5}
    for r in runs:
        assert r.first and r.second and len(r.first) + len(r.second) <= 61
        assert r.tokens == ["[CLS]", *r.first, "[SEP]", *r.second, "[SEP]"]
        assert r.segments == [0] * (len(r.first) + 2) + [1] * (len(r.second) + 1)
    of_long = sorted((r for r in runs if r.d == 5), key=lambda r: r.run)
    assert of_long[0].start == 0 and all(a.start < b.start <= a.stop for a, b in zip(of_long, of_long[1:]))
    assert all(b.start == a.stop for a, b in zip(of_long, of_long[1:]) if not a.is_random)
    assert 0.4 < sum(r.is_random for r in of_long) / len(of_long) < 0.6
    assert not {w for r in of_long if r.is_random for w in r.second} & {"x"}  # the tail of another document


def test_sentence_runs_of_one_document_and_of_none(spark):
    one = spark.createDataFrame([(1, [["a"], ["b"], ["c"]])], "d long, s array<array<string>>")
    assert all(r.is_random == 0 for r in pretraining.sentence_runs(one, "d", "s", 64).collect())
    assert pretraining.sentence_runs(one.limit(0), "d", "s", 64).count() == 0


@pytest.mark.parametrize("n,shards", [(3000, 8), (40, 16), (5, 8), (0, 4)])
def test_filled_shards_near_greedy(spark, n, shards):
    rng = random.Random(n)
    sizes = [int(rng.paretovariate(1.1)) + 1 for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc long, n long")
    got = pretraining.filled_shards(docs, "doc", F.col("n"), shards).collect()
    assert sorted(r["doc"] for r in got) == [i for i, s in enumerate(sizes) if s >= 2]
    heap = [0] * shards
    for s in sorted((s for s in sizes if s >= 2), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    fills = [0] * shards
    for r in got:
        fills[r["shard"]] += r["size"]
    assert max(fills) <= max(heap) * 1.01 + 1
    assert all((r["split"] == "test") == (r["shard"] < -(-shards // 10)) for r in got)


def test_chain_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    e, y, w = rng.normal(size=(4, 6, 3)), rng.integers(0, 3, (4, 6)), rng.normal(size=(4, 3))
    ll, grad = crf.likelihood(e, y, w)
    assert ll == pytest.approx(sum(crf.likelihood(e[i : i + 1], y[i : i + 1], w)[0] for i in range(4)))
    assert ll == pytest.approx(sum(plain_score(e[i], y[i], w) - sequence.forward_score(started(e[i], w), w[:-1]) for i in range(4)))
    for i, j in np.ndindex(w.shape):
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        assert grad[i, j] == pytest.approx((crf.likelihood(e, y, w + step)[0] - crf.likelihood(e, y, w - step)[0]) / 2e-5, abs=1e-6)


def started(e, w):
    e = e.copy()
    e[0] += w[-1]
    return e


def plain_score(e, y, w):
    return sum(e[t, y[t]] for t in range(len(y))) + w[-1, y[0]] + sum(w[a, b] for a, b in zip(y, y[1:]))


def test_chain_learns_and_beats_single_labels(spark):
    rng = np.random.default_rng(7)
    moves, rows = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]]), []
    for i in range(240):
        y = [int(rng.integers(0, 3))]
        for _ in range(int(rng.integers(0, 30))):
            y.append(int(rng.choice(3, p=moves[y[-1]])))
        e = rng.normal(size=(len(y), 3)) + np.eye(3)[y]
        rows.append((i, e.tolist(), y))
    odd = [(900, None, None), (901, [], []), (902, [[1.0, 2.0, 3.0]], [0, 1]), (903, [[1.0, 2.0, 3.0]], [None])]
    data = spark.createDataFrame(rows + odd, "i long, e array<array<double>>, y array<int>")
    chain = crf.fit(data.where("i % 3 > 0 OR i >= 900"), "e", "y", 3, rounds=15)
    assert len(chain.history) > 5 and all(a < b for a, b in zip(chain.history, chain.history[1:]))
    held = {r[0]: r for r in rows if r[0] % 3 == 0}
    best = sequence.decode(data.where("i % 3 = 0 AND i < 900").select("i", chain.started(F.col("e")).alias("e")), "i", "e", chain.transitions).collect()
    chained = sum(sum(a == b for a, b in zip(r["path"], held[r["i"]][2])) for r in best)
    alone = sum(int((np.argmax(e, 1) == y).sum()) for _, e, y in held.values())
    assert chained > 1.15 * alone
    assert not crf.fit(data.limit(0), "e", "y", 3).weights.any()


def test_samples_that_need_their_whole_size(spark):
    rows = spark.range(500).withColumn("slot", F.col("id"))
    got = relational.replacing_sample(rows.select("id"), ["id"], F.col("id"), 20).collect()
    assert sorted(r["slot"] for r in got) == list(range(20)) and len({r["id"] for r in got}) == 20
    assert max(r["id"] for r in got) > 100
    assert relational.reservoir(rows, F.col("id"), 20, whole=True).count() == 20
    for sample in (lambda: relational.replacing_sample(rows.select("id"), ["id"], F.col("id"), 501), lambda: relational.reservoir(rows, F.col("id"), 501, whole=True)):
        with pytest.raises(ValueError, match="fewer than 501"):
            sample()


def test_span_rows_and_model_families(spark):
    rows = spark.createDataFrame([(1, "a b c d", [2, 3]), (2, None, None), (3, "", [0, 0])], "i long, t string, s array<int>")
    got = {r["i"]: (r["tokens"], r["start"], r["end"]) for r in labels.span_offset_rows(rows, ["i"], "t", "s", ["start", "end"], 5).collect()}
    assert got == {1: (["[CLS]", "a", "b", "c", "[SEP]"], 2, 3), 2: (["[CLS]", "[SEP]", *["[PAD]"] * 3], None, None), 3: (["[CLS]", "[SEP]", *["[PAD]"] * 3], 0, 0)}
    names = spark.createDataFrame([("BartModel",), ("GPT2Model",), ("Unknown",), (None,)], "n string")
    assert [r[0] for r in names.select(model.family_attribute(F.col("n"), strict=False)).collect()] == ["model", "transformer", None, None]
    with pytest.raises(Exception, match="no model family"):
        names.select(model.family_attribute(F.col("n"))).collect()
