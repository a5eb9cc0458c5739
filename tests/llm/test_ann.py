"""Nearest neighbours: recall against brute force, exact scores, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import ann
from lexivec.llm.queries import op2_cross_polytope


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = by_query(op2_cross_polytope(spark, d).collect())
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    for q, found in got.items():
        assert all(math.isclose(s, float((vectors[q] * vectors[v]).sum()), rel_tol=1e-12) for v, s in found)
    assert recall(got, want) >= 0.95


def test_unequal_norms_ties_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = {i: rng.normal(size=16) * rng.uniform(0.2, 3) for i in range(600)}
    for i in range(100, 160):
        x[i] = x[100].copy()
    rows = [(i, v.tolist(), 0, "clash") for i, v in x.items()]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [1.0, None] + [0.0] * 14), (1060, [float("nan")] + [1.0] * 15), (1080, [float("inf")] + [1.0] * 15), (1100, []), (1120, [1.0, 2.0]), (None, [1.0] * 16)]
    rows += [(i, v, 0, "clash") for i, v in bad] + [(5, x[5].tolist(), 0, "clash")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = by_query(op2_cross_polytope(spark, str(tmp_path)).collect())
    want = brute(x, [i for i in x if i % 20 == 0], 20)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for found in got.values():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert [v for v, _ in got[120]][:5] == [v for v, _ in want[120]][:5]


def test_split_buckets_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 if i % 3 else 0.001) + (np.arange(8) == 0) * 5).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (by_query(ann.nearest(df, is_query=F.col("vec_id") % 20 == 0, chunk=c).collect()) for c in (4096, 16))
    assert one == many


def test_few_candidates_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, is_query=F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op2_cross_polytope(spark, str(tmp_path)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 32))
    y = ann.rotate(x, 3, 11)
    assert np.allclose(x @ x.T, y @ y.T)


@pytest.mark.parametrize("norms", ["outlier", "lognormal"])
def test_recall_with_unequal_norms_and_a_wider_row(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x *= rng.lognormal(size=(8000, 1)) if norms == "lognormal" else np.where(np.arange(8000) == 7, 100, 1)[:, None]
    vectors = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(9000, [1.0] * 65)], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, is_query=F.col("vec_id") % 200 == 0).collect())
    want = brute(vectors, range(0, 8000, 200), 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_a_wider_row_hides_no_other(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0] * 3)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df, is_query=F.col("vec_id") % 20 == 0).collect()] == [(0, 1)]
