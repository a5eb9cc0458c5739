"""Importance resampling against its plain definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lexivec.llm import resampling
from lexivec.llm.queries import op12_word_trie_resampling


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x, longest)) for side in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = features(x, longest)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    drawn = len(able) * percent // 100
    ranked = [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)]
    return sorted(ranked + [(*r, None) for r in rows if r[1] < min_words], key=str)


def corpus(n=300):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefgÉß9", k=rng.randint(1, 7))) for _ in range(400)] + ["the"] * 200
    text = lambda: rng.choice([" ", "-", "\n", "\x85 "]).join(rng.choices(vocab, k=rng.choice([3, 19, 20, 60, 200])))
    docs = [(i, text()) for i in range(n)] + [(7, "Same words here " * 9)] * 2 + [(None, "no id " * 20), (901, None), (902, ""), (903, "... \x7f\x00 []"), (904, "THE the ThE " * 40_000)]
    return docs, [text() for _ in range(40)] + [None, ""]


@pytest.mark.parametrize("longest, max_nodes", [(1, 200_000), (1, 50), (3, 200_000), (3, 37)])
def test_resample_equals_plain_version(spark, longest, max_nodes):
    docs, target = corpus()
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, weight string, rank int").repartition(3)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(df, goal, longest=longest, percent=30, buckets=1000, max_nodes=max_nodes)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target, longest, 1000, percent=30)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "a b c " * 10) for i in range(10)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain([(i, "a b c " * 10) for i in range(10)], [])
    assert resampling.resample(some.where("doc_id < 9"), none).where("rank IS NOT NULL").count() == 0


def test_query(spark):
    from given_tables import DIR, rows

    got = op12_word_trie_resampling(spark, DIR)
    want = plain([(r["doc_id"], r["text"]) for r in rows("documents")], [r["text"] for r in rows("benchmark")])
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == sorted(((r[0], *r[2:]) for r in want), key=str)
