"""Suffix-array dedup against its plain definition, and the two-stage sort against sorting."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from given_tables import DIR, rows
from lexivec.llm import suffixes
from lexivec.llm.queries import op13_suffix_array_dedup


def plain(docs, length=100):
    """Per document: bytes, removed bytes, removed runs, what is left."""
    first, out = {}, []
    raws = [(i, (t or "").encode()) for i, t in docs]
    for d, (_, raw) in enumerate(raws):
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], (d, p))
    for d, (i, raw) in enumerate(raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] != (d, p):
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[:-1] > np.r_[False, gone[:-2]]).sum()) if len(raw) else 0, kept))
    return out


def found(df):
    return sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) for r in df.collect()), key=str)


def test_op13_equals_plain_version(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in rows("documents"))
    want = [(i, n, gone, k, hashlib.sha256(kept).hexdigest()) for i, n, gone, k, kept in plain(docs)]
    got = op13_suffix_array_dedup(spark, DIR)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[2] for r in want) > 0


def made(rng, n):
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("abcdeé", k=rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    texts += ["a" * 700, "ab" * 300, "", texts[0], texts[0][3:], "x" * 19 + "é" * 40]
    return texts


@pytest.mark.parametrize("length, gram, max_group, piece", [(20, 8, 4096, 4 << 20), (20, 8, 2, 4 << 20), (20, 8, 1, 90), (17, 16, 3, 64), (24, 24, 2, 1000)])
def test_made_documents(spark, length, gram, max_group, piece):
    rng = random.Random(length + max_group)
    docs = list(enumerate(made(rng, 60)))
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, id string, _kept string").select("doc_id", "text", "id").repartition(3)
    got = suffixes.without_repeats(df, length=length, gram=gram, max_group=max_group, piece=piece)
    assert got.columns == ["doc_id", "text", "id", "_kept", "_n_bytes", "_n_removed", "_n_spans"]
    assert found(got) == sorted(plain(sorted(docs), length), key=str)
    for r in got.collect():
        assert r.text == bytes(r._kept).decode("utf-8", "replace")


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(empty).count() == 0
    text = "".join(random.Random(3).choices("abcdefgh", k=150))
    docs = [(5, text), (5, text), (None, text[:120]), (6, text), (7, None), (8, ""), (9, text[:99]), (10, None)]
    got = found(suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    kept = lambda a: text.encode()[a:]
    # The null id comes first; both rows of 5 are one document, which keeps what only it has so far.
    want = [(5, 150, 120, 1, kept(120)), (5, 150, 120, 1, kept(120)), (None, 120, 0, 0, text[:120].encode()), (6, 150, 150, 1, b""), (7, 0, 0, 0, b""), (8, 0, 0, 0, b""), (9, 99, 0, 0, text[:99].encode()), (10, 0, 0, 0, b"")]
    assert got == sorted(want, key=str)
    assert {r.text for r in suffixes.without_repeats(spark.createDataFrame(docs[4:5], "doc_id long, text string")).collect()} == {None}


def test_long_text_of_one_letter(spark):
    docs = [(1, " " * 300_000), (2, "z" * 50 + " " * 300_000)]
    assert found(suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == sorted(plain(docs), key=str)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "a", "zyxw"])
def test_two_stage_sorts_all_suffixes(alphabet):
    rng = random.Random(7)
    for _ in range(100):
        bodies = ["".join(rng.choices(alphabet, k=rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 8))]
        x = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        w = suffixes.words_at(x)
        order = suffixes.two_stage(x, w, 60)
        assert sorted(order.tolist()) == list(range(len(x)))
        own = [bytes(x[i:]).split(b"\0")[0] for i in order]
        assert own == sorted(own)
        shared = suffixes.common_prefixes(order, w, 30).tolist()
        for k in range(1, len(order)):
            a, b = bytes(x[order[k - 1] :]) + b"\0" * 40, bytes(x[order[k] :]) + b"\0" * 40
            same = next((i for i in range(30) if a[i] != b[i]), 30)
            assert shared[k] == same


def test_kinds():
    x = np.frombuffer(b"banana\0", np.uint8)
    assert suffixes.kinds(x).tolist() == [False, True, False, True, False, False, True]


class Plan:
    """Stands for a table: gives the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def batch_of(texts):
    n = np.arange(len(texts))
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(n + 7), pa.array(texts)], ["id", "h", "text"])


def test_a_slice_of_text_is_dealt_in_little_memory():
    letters = np.random.default_rng(4).integers(97, 123, suffixes.SLICE + 50_000, np.uint8).tobytes().decode()
    texts = [letters[i : i + 4000] for i in range(0, len(letters), 4000)] + [letters[5000:6000]]
    tracemalloc.start()
    n = []
    for out in suffixes.dealt(Plan(), 100, 32, suffixes.SLICE)(iter([batch_of(texts)])):
        assert [str(c) for c in out.schema.types] == ["int64"] * 5 + ["int32"] * 2 + ["binary"]
        n.append(out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) > 100_000
    assert peak < 80e6  # an executor holds several such tasks
    assert max(n) < 20_000


@pytest.mark.parametrize("stretch, most", [(1, 1 << 18), (50, 7), (101, 100)])
def test_stretches_give_the_same_segments(monkeypatch, stretch, most):
    rng = random.Random(stretch)
    texts = [t for t in made(rng, 30) if t]
    parts = next(suffixes.slices(iter([batch_of(texts)]), 20, 1 << 20))
    whole = suffixes.cut(parts, 20, 8)
    items = [r for b in suffixes.dealt(Plan(), 20, 8, 1 << 20)(iter([batch_of(texts)])) for r in b.to_pylist()]
    monkeypatch.setattr(suffixes, "STRETCH", stretch)
    for a, b in zip(whole, suffixes.cut(parts, 20, 8), strict=True):
        assert a.tolist() == b.tolist()
    x, part, first, n, a, key, start = whole
    with np.errstate(over="ignore"):
        h = suffixes.gram_hashes(x, 8) & ~suffixes.PLACE
    strings = [(p, i) for p, (*_, raw) in enumerate(parts) for i in range(len(raw) - 19)]
    assert strings == [(p, i + k) for p, i, m in zip(part.tolist(), start.tolist(), n.tolist()) for k in range(m)]
    for f, m, at in zip(first.tolist(), n.tolist(), a.tolist()):
        assert {f + k + int(np.argmin(h[f + k : f + k + 13])) for k in range(m)} == {f + at}
    # Fewer segments compared at once: the same rows, more of them with a body, and never without one that is earlier.
    monkeypatch.setattr(suffixes, "SEGMENTS", most)
    monkeypatch.setattr(suffixes, "ROWS", 5)
    again = [r for b in suffixes.dealt(Plan(), 20, 8, 1 << 20)(iter([batch_of(texts)])) for r in b.to_pylist()]
    assert [r | {"body": None} for r in again] == [r | {"body": None} for r in items]
    assert all(b["body"] == a["body"] for a, b in zip(items, again, strict=True) if a["body"] is not None)
