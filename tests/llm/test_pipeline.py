"""The pipeline's stages against what each must keep, change and drop."""

import itertools
import random
import re

import pytest

import corpus_pipeline as cp
from lexivec.llm.packing import tokenizer
from lexivec.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]
BAD = ["grrrvile", "grrrmean", "snarlish"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    texts = {i: prose(rng.randint(6, 12)) for i in range(300)}
    labels = []
    for i in range(0, 300, 5):
        w = texts[i].split(" ")
        for _ in range(max(4, len(w) // 20)):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        texts[i] = " ".join(w)
    labels = [(i, 1, int(i % 5 == 0)) for i in range(240)]
    passage = " ".join(word() for _ in range(60)) + "."
    for i in range(1, 60, 5):
        texts[i] += "\n" + passage
    copies = {1000: texts[2], 1001: texts[2], 1002: texts[3]}
    near = texts[4].split(" ")
    near[30] = "changed"
    copies[1003] = " ".join(near)
    texts |= copies
    key = "A7f9Kq2ZxW8vLm3RtYc6NbP1sD4gHj5U"
    texts[7] += f'\ntoken = "{key}" and more words here'
    texts |= {2000: None, 2001: "", 2002: "short"}
    rows = [(i, t, "en", "s", None if t is None else len(t), i * 2) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        stages[name] = docs
    return folder, texts, passage, key, stages


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(world):
    *_, stages = world
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS, name


def test_toxicity(world):
    _, texts, _, _, stages = world
    kept = rows_of(stages["toxicity"])
    toxic = {i for i, t in texts.items() if t and any(b in t for b in BAD)}
    assert set(kept) == set(texts) - toxic


def test_line_dedup(world):
    _, _, passage, _, stages = world
    before, after = rows_of(stages["toxicity"]), rows_of(stages["line dedup"])
    assert set(before) == set(after)
    assert sum(passage in (r.text or "") for r in before.values()) > 3
    assert len({r.text for r in after.values() if passage in (r.text or "")}) == 1  # one text keeps it
    for i, r in after.items():
        want = before[i].text
        if want and passage in want and passage not in r.text:
            want = "\n".join(x for x in want.split("\n") if x != passage)
        assert r.text == want
        assert r.n_chars == (None if want is None else len(want))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup(world):
    *_, stages = world
    before, after = rows_of(stages["line dedup"]), rows_of(stages["simhash near-dedup"])
    sets = {i: shingles(r.text) for i, r in before.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(before), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = {b for _, b in near}
    assert near and set(after) == set(before) - gone
    assert {1000, 1001, 1002, 1003, 2001} <= gone
    assert all(after[i] == before[i] for i in after)


def test_secrets(world):
    _, _, _, key, stages = world
    before, after = rows_of(stages["simhash near-dedup"]), rows_of(stages["secret scan"])
    assert set(before) == set(after)
    changed = [i for i in after if after[i].text != before[i].text]
    assert changed == [7]
    assert key not in after[7].text and "and more words here" in after[7].text and after[7].n_chars == len(after[7].text)


def test_packing(world):
    *_, stages = world
    coder = tokenizer(vocabulary())
    docs, pieces = rows_of(stages["secret scan"]), stages["best-fit packing"].collect()
    size = {i: len(coder.encode(r.text or "", allowed_special="all")) + 1 for i, r in docs.items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == size


def test_run_is_the_stages(spark, world):
    folder, *_, stages = world
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(cp.run(spark, folder).collect()) == key(stages["best-fit packing"].collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stage_names():
    assert [re.sub(r"\W", " ", n) for n, _ in cp.STAGES] == ["toxicity", "line dedup", "simhash near dedup", "secret scan", "best fit packing"]
