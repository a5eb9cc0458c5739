"""Toxicity and language identification: held-out accuracy, odd rows, and small plain checks."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexivec.llm import langid, toxicity
from lexivec.llm.queries import op5_ordinal_toxicity, op6_byte_network

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "der"], "cc": ["çã", "õe", "nh", "lh"]}


def language_rows(n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
        rows.append((i, " ".join(word() for _ in range(rng.randint(5, 400))), lang if i % 7 else None, "x", 1.0))
    return rows + [(1000, None, "aa", "x", 1.0), (1001, "", "bb", "x", 1.0), (1002, "12 !? \n", "bb", "x", 1.0), (1003, "½ ² Ⅷ ٣ _", "bb", "x", 1.0), (None, "kalo mitu", "aa", "x", 1.0), (3, "kalo " * 30000, "aa", "x", 1.0)]


def test_op6_held_out_accuracy_and_odd_rows(spark, tmp_path):
    rows = language_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_byte_network(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: sorted(SYLLABLES)[i % 3] for i in range(240)}
    import zlib

    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 1000} == dict.fromkeys(range(1000, 1004), "und")


def test_op6_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "kalo mitu", "aa" if i % 2 else "bb") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df, may_learn=F.col("doc_id") % 2 == 1)
    assert net.languages == ["aa"]
    assert langid.fit(df, may_learn=F.lit(False)) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_network_pooling_equals_plain_convolution():
    rng = np.random.default_rng(0)
    net = langid.ByteNet(["a", "b"], 12, [rng.normal(size=(w, 256, 3)) for w in (2, 4)], [rng.normal(size=3) for _ in range(2)], rng.normal(size=(6, 2)), np.zeros(2))
    x = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    want = [[max(0.0, max(sum(t[j, row[i + j], f] for j in range(len(t))) for i in range(12 - len(t) + 1)) + b[f]) for t, b in zip(net.tables, net.bias) for f in range(3)] for row in x]
    assert np.allclose(net.pooled(x)[0], want)


def test_windows_cover_every_byte():
    for n in (0, 1, 7, 8, 9, 20, 21, 100):
        text = bytes(range(n))
        x, _, size = langid.windows_of([text], 8, 3)
        seen = {b for row, k in zip(x.tolist(), size) for b in row[:k]}
        assert seen == set(range(n))


def toxic_rows(n=900):
    rng = random.Random(2)
    clean = ["wort%s" % "abcdefghij"[k] * 1 + "xyz"[k % 3] for k in range(10)] + ["the", "and", "of", "to", "in"]
    bad = ["grrrvile", "grrrmean", "snarlish"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) + "abcde"[rng.randrange(5)] for _ in range(rng.randint(40, 160))]
        y = int(i % 6 == 0)
        if y:
            for _ in range(max(3, len(words) // 30 * (1 + i % 3))):
                words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words), "clash", 0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, y if rng.random() > 0.03 else 1 - y))
    return docs, labels


def test_op5_ordinal(spark, tmp_path):
    docs, labels = toxic_rows()
    docs += [(5000, None, "c", 0), (5001, "", "c", 0), (None, "grrrvile " * 50, "c", 0), (0, docs[0][1], "c", 0), (5002, "the " * 100000, "c", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, grade string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_ordinal_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 5000 and r.toxic != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 15
    by = {r.doc_id: r for r in got}
    assert not by[5000].toxic and not by[5001].toxic and not by[5002].toxic and by[None].toxic
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in got)


def test_op5_without_labels_rejects_nothing(spark, tmp_path):
    spark.createDataFrame(toxic_rows(20)[0], "doc_id long, text string, grade string, toxic int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op5_ordinal_toxicity(spark, str(tmp_path)).where("toxic OR expected_severity > 0.001").count() == 0


def test_fit_ordinal_recovers_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = np.digitize(latent, [-1.0, 1.0, 2.5])
    w, theta = toxicity.fit_ordinal(x, grade, 4)
    assert np.allclose(w, [2, -1, 0], atol=0.25)
    assert np.allclose(theta, [-1, 1, 2.5], atol=0.3)


def test_op5_and_op6_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op5_ordinal_toxicity(spark, str(tmp_path)).count() == 0
    assert op6_byte_network(spark, str(tmp_path)).count() == 0


def plain_probabilities(net, text):
    """Every window of a text, one by one, with plain loops."""
    data, step = text.encode(), net.length - (max(map(len, net.tables)) - 1)
    total, weight = np.zeros(len(net.languages)), 0
    for k in range(max(1, -(-(len(data) - net.length + step) // step))):
        part = data[k * step : k * step + net.length]
        row = list(part) + [0] * (net.length - len(part))
        hidden = [max(0.0, max(sum(t[j, row[i + j], f] for j in range(len(t))) for i in range(net.length - len(t) + 1)) + b[f]) for t, b in zip(net.tables, net.bias) for f in range(len(b))]
        z = np.array(hidden) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        total += p / p.sum() * len(part)
        weight += len(part)
    return total / weight


def test_op6_prediction_equals_plain_version_and_ties_go_first(spark):
    rng = np.random.default_rng(1)
    net = langid.ByteNet(["a", "b", "c"], 12, [rng.normal(size=(w, 256, 3)) for w in (2, 4)], [rng.normal(size=3) for _ in range(2)], rng.normal(size=(6, 3)), np.zeros(3))
    texts = ["x", "kalo mitu", "é" * 11 + "z", "ab" * 100, "ab" * 100, "12", None, "ª"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(df, net).collect():
        if not texts[r.doc_id] or not any(c.isalpha() for c in texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            p = plain_probabilities(net, texts[r.doc_id])
            assert r.lang_pred == net.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-9
    net.out[:] = 0
    assert {(r.lang_pred, round(r.score, 9)) for r in langid.predict(df.where("doc_id < 3"), net).collect()} == {("a", round(1 / 3, 9))}


def test_op6_learns_rare_languages(spark):
    rows = [(i, "kalo mitu lomi", "aa") for i in range(3000)] + [(i, "schung einder", "zz") for i in range(3000, 3004)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), may_learn=F.lit(True), max_docs=40, epochs=1)
    assert net.languages == ["aa", "zz"]


def test_op5_scores_equal_plain_version(spark):
    words = {"vile": 0, "mean*": 1, "meanes*": 2}
    model = toxicity.OrdinalModel(words, np.array([0.4, 0.2, -0.1]), np.array([1.0, 2.0, 2.5]))
    texts = [None, "", "Vile vile, MEANEST 12 mean-spirited x", "nothing here", "vile " * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        tokens = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        x = [0.0, 0.0, 0.0]
        for w in tokens:
            for name, k in words.items():
                if w == name or (name.endswith("*") and len(w) >= len(name) - 1 and w.startswith(name[:-1]) and len(name) - 1 in toxicity.STEMS):
                    x[k] += 1000 / (len(tokens) + toxicity.SHORT)
        eta = sum(a * b for a, b in zip(x, model.weights))
        above = [1 / (1 + np.exp(t - eta)) for t in model.theta]
        p = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert abs(r.expected_severity - sum(above)) < 1e-9
        assert r.grade == max(range(4), key=lambda k: p[k]) and r.toxic == (sum(above) >= 0.5)


def test_grades_are_what_other_folds_agree_on():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 2)) * 0.3 + y[:, None] * np.array([3.0, 0.0])
    x[y == 1] *= rng.choice([0.1, 1.0], ((y == 1).sum(), 1))
    grade = toxicity.agreement(x, y, np.arange(400) % toxicity.FOLDS)
    assert (grade[y == 0] == 0).all() and set(grade[y == 1].tolist()) <= {1, 2, 3}
    weak = x[:, 0] < 0.8
    assert grade[(y == 1) & weak].mean() + 0.8 < grade[(y == 1) & ~weak].mean()
