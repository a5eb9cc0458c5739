"""The stored exact index and the span reader against comparing everything."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import index, intervals, reading, vectors
from lexivec.plans import catalog


def table(spark, x, ids=None):
    rows = [(int(i), v if v is None else [float(y) for y in v], "clash") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, ball string")


def plain(x, ids, asked, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in zip(ids, x, strict=True) if v is not None and np.linalg.norm(v) > 0 and np.isfinite(v).all()}
    out = {}
    for q in asked:
        if q in unit:
            s = sorted(((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q))[:k]
            out[q] = [(i, -t) for t, i in s]
    return out


def by_query(found):
    out = {}
    for r in found.orderBy("query_id", F.desc("score"), "vec_id").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def test_index_equals_comparing_all_on_clustered_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(1200, 24))
    x[7] = x[8]
    made = index.build(table(spark, x), f"{tmp_path}/index")
    asked = table(spark, x).where("vec_id % 20 = 0")
    found, visited = index.search(made, asked, 6)
    assert by_query(found) == plain(x.tolist(), range(1200), range(0, 1200, 20), 6)
    share = visited.agg(F.sum("visited")).first()[0] / (60 * 1200)
    assert share < 0.25, share
    again = index.stored(spark, f"{tmp_path}/index")  # built once, searched later
    assert by_query(index.search(again, asked, 6)[0]) == by_query(found)
    assert {(r.vid, r.id) for r in again.ids().collect()} == {(i, i) for i in range(1200)}


def test_index_of_spread_rows_in_small_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CHUNK", 16)
    monkeypatch.setattr(index, "ASKS", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).tolist()
    x[5], x[6], x[9] = None, [0.0] * 8, [float("nan")] * 8
    x[11] = [2 * y for y in x[10]]
    made = index.build(table(spark, x), f"{tmp_path}/index", balls=5)
    found, visited = index.search(made, table(spark, x).where("vec_id < 120"), 9)
    assert by_query(found) == plain(x, range(300), range(120), 9)
    assert visited.where("visited > 297").count() == 0


def test_index_of_few_rows(spark, tmp_path):
    none = index.build(table(spark, []), f"{tmp_path}/none")
    assert index.search(none, table(spark, [[1.0, 2.0]]), 3)[0].count() == 0
    one = index.build(table(spark, [[1.0, 2.0], [2.0, 1.0]]), f"{tmp_path}/one")
    assert by_query(index.search(one, table(spark, [[1.0, 2.0], [0.0, 0.0]], [0, 9]), 3)[0]) == {0: [(1, 0.8)]}


def test_index_query_breaks_ties_of_rounded_scores_by_id(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(6, 8)), 50, axis=0) + 3e-4 * rng.normal(size=(300, 8))  # many scores differ beyond the sixth digit only
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["index_topk"](spark, str(tmp_path)).select("query_id", "vec_id", "vid", "score").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalog.oracle_sql()["index_topk"]).fetchall())
    assert len(want) == 60 and got == want


def spans_of(s, e, width, most):
    pairs = sorted((-(s[i] + e[j]), i, j) for i in range(len(s)) for j in range(i, min(i + width, len(s))))
    taken = []
    for t, i, j in pairs:
        if len(taken) < most and all(j < a or b < i for a, b, _ in taken):
            taken.append((i, j, -t))
    return taken


@pytest.mark.parametrize("width", [1, 2, 5, 16, 500])
def test_top_spans_equal_all_pairs(width):
    rng = random.Random(width)
    for n in (1, 2, 7, 60, 200):
        for values in (lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 2))):  # also ties
            s, e = np.array([values() for _ in range(n)]), np.array([values() for _ in range(n)])
            assert reading.top_spans(s, e, width, 5) == spans_of(s, e, width, 5)


def test_sliding_argmax_on_a_long_row():
    x = np.random.default_rng(1).integers(0, 50, 100_000).astype(float)
    at = reading.sliding_argmax(x, 300)
    for j in range(0, 100_000, 997):
        low = max(0, j - 299)
        assert at[j] == low + int(x[low : j + 1].argmax())


def test_spans_and_answers_of_odd_rows(spark):
    rows = [(0, 0, 0.5, [1.0, 0.0], [0.0, 1.0]), (0, 1, 0.9, None, [1.0]), (0, 2, 0.9, [], []), (0, 3, 0.5, [3.0, None, float("nan")], [1.0, 5.0, 2.0, 9.0]), (1, 4, None, [0.0], [0.0])]
    df = spark.createDataFrame(rows, "q long, p long, r double, s array<double>, e array<double>")
    df = df.withColumn("spans", reading.best_spans(F.col("s"), F.col("e"), width=2, most=3))
    out = reading.answers(df, query="q", passage="p", relevance="r", spans="spans", most=2)
    got = sorted((r["query"], r["rank"], r["passage"], r["start"], r["end"], r["score"]) for r in out.collect())
    assert got == [(0, 1, 0, 0, 1, 2.0), (0, 2, 3, 0, 1, 8.0), (1, 1, 4, 0, 0, 0.0)]


def test_interval_lookup_equals_comparing_all(spark):
    rng = random.Random(4)
    ends = sorted(rng.sample(range(5000), 120))
    spans = [(a, b - 1, f"n{a}") for a, b in zip(ends[::2], ends[1::2], strict=True)] + [(6000, 1_000_000, "long"), (2_000_000, 2_000_000, "one"), (9, 3, "never"), (None, 4, "null")]
    spans = [s for s in spans if s[0] is None or s[0] != 0]
    values = [*range(-3, 6010), 999_999, 1_000_000, 1_000_001, 2_000_000, 1 << 40, None, 7, 7]
    rows = spark.createDataFrame([(v, "clash") for v in values], "v long, low string")
    got = intervals.lookup(rows, "v", spark.createDataFrame(spans, "low long, high long, name string"), "low", "high", "name")
    assert got.columns == ["v", "low", "name"]
    want = [(v, next((n for a, b, n in spans if v is not None and a is not None and a <= v <= b), None)) for v in values]
    assert sorted(((r.v, r["name"]) for r in got.collect()), key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], "low long, high long, name string")
    assert intervals.lookup(rows, "v", none, "low", "high", "name").where("name IS NOT NULL").count() == 0


def test_blocks_are_few_and_cover_the_interval(spark):
    spans = [(0, 0), (0, 7), (3, 12), (5, 1_000_000_000), (1023, 1024), (1 << 40, (1 << 41) + 5)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(spans)], "low long, high long, i int")
    found = {}
    for r in intervals.blocks(df, "low", "high").collect():
        found.setdefault(r.i, []).append((r._block << r._level, ((r._block + 1) << r._level) - 1))
    for i, (a, b) in enumerate(spans):
        own = sorted(found[i])
        assert own[0][0] == a and own[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(own, own[1:]))
        assert len(own) <= 2 * max(1, (b - a + 1).bit_length())


def test_hard_pairs_equal_the_triples_that_violate(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(24, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [int(i % 3) for i in range(22)] + [None, 9]
    rows = spark.createDataFrame([(0, i, label[i], x[i].tolist()) for i in range(24)], "b int, i long, l int, v array<double>")
    got = {(r.anchor, r.other, r.same) for r in vectors.hard_pairs(rows, "b", "i", "l", "v", 0.1).collect()}
    s = np.round(x @ x.T, 9)
    known = [i for i in range(24) if label[i] is not None]
    want = set()
    for a in known:
        for p in known:
            for n in known:
                if p != a and label[p] == label[a] and label[n] != label[a] and s[a, p] - 0.1 < s[a, n]:
                    want |= {(a, p, True), (a, n, False)}
    assert got == want
