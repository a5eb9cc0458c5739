"""Operators against goldens, plain versions and invariants; plans against what they should hold."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.operators import cluster as C
from lexivec.operators import corpus, labels, metrics, model, sequence
from lexivec.operators import generation as G
from lexivec.operators import relational as R
from lexivec.operators import text as O
from lexivec.operators import vectors as VO
from lexivec.plans.tasks import parse_task_set


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_over_many_partitions(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("k"), "id").repartition(13)
    got = [r.n for r in R.dense_ids(rows, ["k"], "n").orderBy("k").collect()]
    assert got == list(range(5000))


def test_running_sum(spark):
    rows = spark.range(1000).repartition(7)
    out = corpus.running_sum(rows, ["id"], F.when(F.col("id") % 10 == 0, 1).otherwise(0), "s").orderBy("id").collect()
    assert [r.s for r in out] == [r.id // 10 + 1 for r in out]


def test_id_maps(spark):
    rows = spark.createDataFrame(list(enumerate("abacb")), "pos long, id string")
    as_dict = lambda df: {r["id"]: r["vid"] for r in df.collect()}
    assert as_dict(VO.id_map(rows, "id", ["pos"])) == {"a": 0, "b": 1, "c": 2}
    assert as_dict(VO.duplicate_map(rows, "id", ["pos"])) == {"a": 2, "b": 3}
    rows = rows.where("pos < 3")
    assert as_dict(VO.id_map(rows, "id", ["pos"], "last")) == {"a": 2, "b": 1}
    assert [(r.vid, r.id) for r in VO.all_vids(rows, "id", ["pos"]).orderBy("vid").collect()] == [(0, "a"), (1, "b"), (2, "a")]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(2000)
    one = {r.id for r in R.hash_sample(rows, F.col("id"), 0.2).collect()}
    other = {r.id for r in R.hash_sample(rows.repartition(9), F.col("id"), 0.2).collect()}
    assert one == other and 300 < len(one) < 500
    assert R.reservoir(rows, F.col("id"), 10).count() == 10
    assert R.reservoir(spark.range(3), F.col("id"), 10).count() == 3


def test_column_checks(spark):
    rows = spark.createDataFrame([(1, 2.0)], "A long, B double")
    assert R.is_subset_schema(rows, rows.withColumn("C", F.lit(1)))
    assert not R.is_subset_schema(rows.withColumn("C", F.lit(1)), rows)
    with pytest.raises(ValueError, match="missing"):
        R.require_columns(rows, "A", "Z")
    assert R.select_fields(rows, ["B"]).columns == ["B"]
    assert R.select_fields(rows).columns == ["A", "B"]


def plain_pairs(sets, t):
    return {(a, b): 1 - len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if x and y and len(x & y) / len(x | y) >= t}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), min_size=1, max_size=25), st.sampled_from([0.5, 0.8, 1.0]))
def test_near_pairs_lose_none(spark, sets, t):
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id long, s array<string>")
    got = {(r.a, r.b): r.distance for r in C.near_pairs(rows, "id", "s", t).collect()}
    want = plain_pairs(dict(enumerate(sets)), t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_near_pairs_join_by_prefix(spark):
    rows = spark.createDataFrame([(i, [str(i + k) for k in range(10)]) for i in range(50)], "id long, s array<string>")
    text = plan(C.near_pairs(rows, "id", "s", 0.8))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_jaccard_golden(spark):
    rows = spark.createDataFrame([(0, list("abc")), (1, list("bcd"))], "id long, s array<string>")
    assert C.jaccard_pairs(rows, "id", "s").first().distance == pytest.approx(0.5)
    counts = spark.createDataFrame([(0, "x", 3), (0, "z", 1), (1, "x", 1), (1, "y", 1), (1, "z", 1)], "id long, t string, n long")
    assert C.bitwise_pairs(counts, "id", "t", "n").first().distance == pytest.approx(0.6)


def test_cut_is_strict():
    d = np.array([[0, 0.2, 0.9, 0.9], [0.2, 0, 0.9, 0.9], [0.9, 0.9, 0, 0.3], [0.9, 0.9, 0.3, 0]])
    cluster, joined = C.cut(C.linkage(d, "complete"), 4, 0.5)
    assert cluster.tolist() == [0, 0, 2, 2] and joined.tolist() == [0.2, 0.2, 0.3, 0.3]
    pair = np.array([[0, 0.5], [0.5, 0]])
    assert C.cut(C.linkage(pair, "complete"), 2, 0.5)[0].tolist() == [0, 1]
    with pytest.raises(ValueError):
        C.linkage(pair, "ward")
    with pytest.raises(ValueError):
        C.clusterer("other")


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted"])
def test_blocks_change_no_cluster(spark, method):
    rng = random.Random(5)
    base = [rng.sample(range(60), 12) for _ in range(4)]
    sets = {}
    for i in range(24):
        s = set(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(60, 90))
        sets[i] = s
    sets[24] = set(sets[0])
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    got = {r["item"]: r.cluster for r in C.hierarchical(rows, "id", "s", 0.6, method, keep_singletons=True).collect()}
    ids = sorted(i for i in sets if i != 24)
    d = np.array([[1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in ids] for a in ids])
    want, _ = C.cut(C.linkage(d, method), len(ids), 0.6)
    assert {i: got[i] for i in ids} == {i: ids[w] for i, w in zip(ids, want)}
    assert got[24] == got[0]


def clustered(sets, method, threshold):
    ids = sorted(sets)
    d = np.array([[1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in ids] for a in ids])
    cluster, joined = C.cut(C.linkage(np.round(d, 12), method), len(ids), threshold)
    return {i: (ids[c], 0.0 if np.isnan(j) else round(j, 9)) for i, c, j in zip(ids, cluster, joined)}


@pytest.mark.parametrize("method, ties", [("single", False), ("complete", True), ("average", False), ("average", True), ("weighted", True)])
def test_rounds_of_mutual_nearest_equal_one_by_one(spark, method, ties):
    rng = random.Random(17 + ties)
    base = [rng.sample(range(40), 10) for _ in range(3)]
    sets = {}
    for i in range(60):
        s = set(base[i % 3])
        for _ in range(rng.randint(0, 2 if ties else 5)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(40, 44 if ties else 90))
        if s not in sets.values():
            sets[3 * i] = s
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    got = {r["item"]: (r.cluster, round(r.distance, 9)) for r in C.hierarchical(rows, "id", "s", 0.7, method, keep_singletons=True, most=1).collect()}
    want = clustered(sets, method, 0.7)
    assert got == want and len({c for c, _ in got.values()}) < len(sets) / 2


@pytest.mark.parametrize("method", ["complete", "average"])
def test_rounds_of_a_large_component(spark, method):
    rng = random.Random(23)
    sets, core = {}, set(range(30))
    while len(sets) < 280:  # a walk: neighbours are near, the ends share little
        core = (core - {rng.choice(sorted(core))}) | {rng.randint(0, 10_000)}
        sets[len(sets)] = set(core)
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, s array<string>")
    got = {r["item"]: (r.cluster, round(r.distance, 9)) for r in C.hierarchical(rows, "id", "s", 0.5, method, keep_singletons=True).collect()}
    assert got == clustered(sets, method, 0.5)


def test_pairs_within_groups_in_chunks(spark):
    rng = random.Random(3)
    sets = {i: set(rng.sample(range(30), rng.randint(1, 8))) for i in range(80)}
    rows = spark.createDataFrame([(i % 2, i, sorted(s)) for i, s in sets.items()], "g int, id long, s array<long>")
    for chunk in (7, 256):
        got = {(r.a, r.b): round(r.similarity, 9) for r in C.pairs_within(rows, "g", "id", "s", chunk).collect()}
        want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and (a - b) % 2 == 0 and sets[a] & sets[b]}
        assert got == want


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    assert {r.id: r.root for r in C.connected(edges).collect()} == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_bio_spans_golden(spark):
    tags = [(1, i, t) for i, t in enumerate(["B-X", "I-X", "O", "B-Y"])] + [(2, i, t) for i, t in enumerate(["I-X", "B-X", "I-Y", "B-X", "B-X"])]
    rows = spark.createDataFrame(tags, "d long, pos long, tag string")
    got = sorted(tuple(r) for r in metrics.bio_spans(rows, ["d"], "pos", "tag").collect())
    assert got == [(1, "X", 0, 1), (1, "Y", 3, 3), (2, "X", 1, 1), (2, "X", 3, 3), (2, "X", 4, 4)]


def test_metric_edges(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1)], "p long, r long")
    out = metrics.classification(rows, "p", "r", "weighted").first()
    assert (out.accuracy, out.precision, out.recall) == (0.5, 1.0, 0.5)
    empty = metrics.classification(rows.where("p > 5"), "p", "r", "macro").first()
    assert empty.f1 == 0
    scores = spark.createDataFrame([("a", 0.5)], "task string, score double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "task string, weight double")
    assert metrics.aggregated(scores, weights).first().score == 0.25
    with pytest.raises(ValueError):
        metrics.metric_for("other")
    assert metrics.metric_for("regression") == "mse"


def test_labels(spark):
    ids = labels.bio_label_ids(spark.createDataFrame([("PER",), ("LOC",)], "l string"))
    assert [r.label for r in ids.orderBy("id").collect()] == ["B-LOC", "B-PER", "I-LOC", "I-PER", "O"]
    rows = spark.createDataFrame([("x",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        labels.with_label_ids(rows, "l", ids).collect()
    with pytest.raises(ValueError, match="converter"):
        labels.convert(rows, "other")
    with pytest.raises(ValueError, match="missing"):
        labels.convert(rows, "next_token")


def test_token_offsets_golden(spark):
    rows = spark.createDataFrame([(1, ["the", "end", "game"])], "id long, t array<string>")
    out = O.token_offsets(rows, F.col("t"), ["id"]).orderBy("pos").collect()
    assert [(r.start, r.stop) for r in out] == [(0, 3), (4, 7), (8, 12)]


def test_packed_examples_invariants(spark):
    rows = [(i, [" ".join("w" * 1 for _ in range(random.Random(i * 31 + k).randint(1, 30))) for k in range(20)]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc long, s array<string>")
    out = corpus.packed_examples(docs, "doc", "s", 64).collect()
    for i, s in rows:
        own = sorted((r for r in out if r.doc == i), key=lambda r: r.example)
        assert sum(r.n_sentences for r in own) == len(s)
        assert all(0 < r.n_tokens <= 61 and 2 <= r.target <= 61 for r in own)
    assert sorted(map(tuple, out)) == sorted(map(tuple, corpus.packed_examples(docs.repartition(5), "doc", "s", 64).collect()))


def test_truncated_pair(spark):
    a, b = (F.array(*[F.lit(f"{x}{i}") for i in range(n)]) for x, n in (("a", 9), ("b", 4)))
    for front in (True, False):
        x, y = corpus.truncated_pair(a, b, 6, F.lit(front))
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert (len(r.x), len(r.y)) == (3, 3)
        assert r.x == ([f"a{i}" for i in (6, 7, 8)] if front else ["a0", "a1", "a2"])


def test_shards_balance(spark):
    docs = spark.createDataFrame([(i, i % 37 + 1) for i in range(400)], "d long, n int")
    out = corpus.shard_plan(docs, "d", F.col("n"), 8)
    assert out.where("sentences < 2").count() == 0
    sizes = [r.s for r in out.groupBy("shard").agg(F.sum("sentences").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 37
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "test"}


def test_viterbi_equals_all_paths(spark):
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    score = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    paths = {p: score(p) for p in itertools.product(range(3), repeat=5)}
    best = max(paths, key=paths.get)
    assert sequence.viterbi(e, t)[0] == list(best)
    assert sequence.viterbi(e, t)[1] == pytest.approx(paths[best])
    assert sequence.forward_score(e, t) == pytest.approx(np.log(np.sum(np.exp(list(paths.values())))))
    rows = spark.createDataFrame([(1, e.tolist()), (2, e[:1].tolist()), (3, [])], "k long, e array<array<double>>")
    assert {r.k: len(r.path) for r in sequence.decode(rows, "k", "e", t).collect()} == {1: 5, 2: 1}


def test_encoder_and_pooling(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a b c")], "id long, t string")
    got = {r.id: r.v for r in rows.select("id", model.encode("t", model.EncoderSpec()).alias("v")).collect()}
    assert got[1] == got[3] and not any(got[2])
    assert sum(x * x for x in got[1]) == pytest.approx(1)
    assert model.pooling("local", "cls") is not None
    with pytest.raises(ValueError):
        model.pooling("local", "other")
    tokens = spark.createDataFrame([(1, ["un", "##do", "it"], [0, 2, 0], [[0.0, 1.0], [9.0, 0.0], [2.0, 1.0]])], "id long, t array<string>, o array<int>, z array<array<double>>")
    out = model.classified_tokens(tokens, ["id"], "t", "o", "z", ["O", "X"]).orderBy("pos").collect()
    assert [(r.token, r.label) for r in out] == [("un", "X"), ("it", "O")]


def test_script_ranges(spark):
    ranges = O.script_ranges(spark).cache()
    assert ranges.where("low <= 65 AND high >= 65").first().script == "Latin"
    assert ranges.where("low <= 44032 AND high >= 44032").first().script == "Hangul"
    assert ranges.where("script = 'Thai'").agg(F.min("low")).first()[0] == 0x0E01


def test_pushed_filters_and_pruned_columns(spark):
    d = "/root/testdata/sf0.001"
    from lexivec.plans.relational import filter_nonempty_id

    text = plan(filter_nonempty_id(spark, d))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,))]" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_task_settings():
    settings_ = {"domain": "d", "training": {"snapshot": 1}, "ner": {"type": "token_classification", "input_columns": {"text": "text", "t": "tokens"}}}
    tasks = parse_task_set(settings_)
    assert tasks["ner"].columns("tokens") == ["t"] and tasks["ner"].schema() == "text string, t array<string>"
    for bad in ({"domain": "d"}, {**settings_, "x": {"type": "no"}}, {**settings_, "x": {"type": "regression"}}):
        with pytest.raises(ValueError):
            parse_task_set(bad)


def test_label_conversion_edges(spark):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "label string, id long")
    rows = spark.createDataFrame([("x", "b"), ("y", None)], "text string, label string")
    assert [r.labels for r in labels.convert(rows, "sequence_classification", ids).collect()] == [1, None]
    many = spark.createDataFrame([("x", ["b"]), ("y", [])], "text string, labels array<string>")
    assert [r.labels for r in labels.convert(many, "multi_label_classification", ids).collect()] == [[0.0, 1.0], [0.0, 0.0]]
    tokens = spark.createDataFrame([([None, 0, 0, 1, None], ["b", "a"]), ([], [])], "word_ids array<int>, labels array<string>")
    assert [r.labels for r in labels.convert(tokens, "token_classification", ids).collect()] == [[-100, 1, 1, 0, -100], []]
    with pytest.raises(ValueError, match="label ids"):
        labels.convert(rows, "sequence_classification")
    with pytest.raises(Exception, match="unknown label c"):
        labels.convert(spark.createDataFrame([("x", "c")], "text string, label string"), "sequence_classification", ids).collect()
    with pytest.raises(ValueError, match="with_label_ids"):
        labels.label_map(ids, most=1)
    assert labels.convert(rows.where("label = 'none'"), "sequence_classification", ids.where("id < 0")).count() == 0


def generated(texts, prompts, beams, max_length, min_length, **options):
    """A plain version: hypotheses of every prompt in a list."""
    counts = {}
    for t in texts:
        w = ["<s>", "<s>", *t, "</s>"]
        for a, b, c in zip(w, w[1:], w[2:]):
            counts.setdefault((a, b), {}).setdefault(c, 0)
            counts[a, b][c] += 1
    out = {}
    for key, (a, b) in prompts.items():
        held = [(0, "", False, False, a, b, 0)]
        for step in range(max_length):
            if all(h[2] for h in held):
                break
            grown = [h for h in held if h[2]]
            for score, text, _, _, x, y, n in (h for h in held if not h[2]):
                follow = counts.get((x, y), {})
                best = [t for t in sorted(follow, key=lambda t: (-follow[t], t))[: beams + 1] if step >= min_length or t != "</s>"]
                for t in best:
                    s = score + round(math.log(follow[t] / sum(follow.values())) * 1e6)
                    grown.append((s, text, True, True, y, t, n) if t == "</s>" else (s, f"{text} {t}".strip(), False, False, y, t, n + 1))
                if not best:
                    grown.append((score, text, True, False, x, y, n))
            held = sorted(grown, key=lambda h: (-h[0], h[1], not h[3]))[:beams]
        out[key] = [(h[1], h[0], h[6], h[3]) for h in held]
    return out


@pytest.mark.parametrize("beams, length, least", [(1, 9, 0), (1, 12, 4), (3, 8, 0), (4, 10, 3)])
def test_generation_equals_plain_version(spark, beams, length, least):
    rng = random.Random(beams + length)
    texts = [[rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(60)]
    prompts = {0: ("<s>", "<s>"), 1: ("a", "b"), 2: ("c", "c"), 3: ("no", "where"), 4: ("<s>", "d")}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "w array<string>")
    model = G.next_tokens(rows, "w", beams + 1)
    got = {}
    asked = spark.createDataFrame([(k, *v) for k, v in prompts.items()], "id long, c1 string, c2 string")
    for r in G.generate(asked, model, beams=beams, max_length=length, min_length=least).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.text, r.score, r.n_tokens, r.ended))
    assert got == generated(texts, prompts, beams, length, least)
    assert G.generate(asked.where("id < 0"), model, beams=beams, max_length=length).count() == 0


def test_drawn_tokens_follow_the_distribution(spark):
    rows = spark.createDataFrame([(["x"],)] * 3 + [(["y"],)] * 1 + [(["z"],)] * 1, "w array<string>")
    asked = spark.range(4000).selectExpr("id", "'<s>' AS c1", "'<s>' AS c2")
    draw = lambda **o: {r["text"]: r["n"] for r in G.generate(asked, G.next_tokens(rows, "w", 9), max_length=1, seed=7, **o).groupBy("text").agg(F.count("*").alias("n")).collect()}
    free, two = draw(top_k=5), draw(top_k=2)
    assert abs(free["x"] - 2400) < 150 and abs(free["y"] - 800) < 150 and sum(free.values()) == 4000
    assert set(two) == {"x", "y"} and abs(two["x"] - 3000) < 150
    assert draw(top_k=5) == free  # the same draw each time
