"""The template tree against a plain one-machine version of the same rules."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from lexivec.llm import linededup
from lexivec.llm.queries import op10_template_line_dedup


def mask(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in re.split("[\x20\x09-\x0d]+", line) if w)


def plain(texts, min_docs=3, similarity=0.8, depth=3):
    """Equal texts are one; of a recurring template's lines, those of one text stay, and nothing but the texts says which."""
    different = sorted({t for t in texts if t is not None})
    lines = [(t, i, mask(x)) for t in different for i, x in enumerate(t.split("\n")) if mask(x)]
    leaves = defaultdict(set)
    for _, _, m in lines:
        leaves[len(m), m[:depth]].add(m)
    name = {}
    for members in leaves.values():
        members = sorted(members)
        for m in members:
            name[m] = m
        for i, m in enumerate(members):
            for o in members[:i]:
                if sum(a == b for a, b in zip(m, o)) >= similarity * len(m) - 1e-9 and name[m] != name[o]:
                    old, new = name[m], name[o]
                    for x in members:
                        if name[x] == old:
                            name[x] = new
    holders = defaultdict(set)
    for t, _, m in lines:
        holders[name[m]].add(t)
    return lines, name, {k: v for k, v in holders.items() if len(v) >= min_docs}


def check(texts, got, **rules):
    """``got`` against the plain version: outside recurring templates nothing goes; each of those stays whole in one text and leaves all others."""
    lines, name, recurring = plain(texts, **rules)
    left = dict(zip(texts, got, strict=True))
    assert left.get(None) is None
    assert [left[t] for t in texts] == got  # equal texts end alike
    keeps = defaultdict(set)
    want = {}
    for t in left:
        if t is not None:
            rest = left[t].split("\n") if left[t] else []
            own = [(i, x) for i, x in enumerate(t.split("\n"))]
            at = {i: m for u, i, m in lines if u == t}
            for i, x in own:
                if i not in at or name[at[i]] not in recurring:
                    assert x in rest or x == ""
            want[t] = own, at
    for k, texts_of in recurring.items():
        for t in texts_of:
            own, at = want[t]
            mine = Counter(x for i, x in own if i in at and name[at[i]] == k)
            if all(Counter(left[t].split("\n"))[x] >= n for x, n in mine.items()):
                keeps[k].add(t)
            else:
                assert not any(x in left[t].split("\n") for x in mine)
        assert len(keeps[k]) == 1, (k, len(keeps[k]))
    for t, (own, at) in want.items():
        kept = [x for i, x in own if i not in at or name[at[i]] not in recurring or t in keeps[name[at[i]]]]
        assert left[t] == "\n".join(kept)
    return recurring


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = []
    for i in range(120):
        lines = [prose(rng.randint(8, 30)) for _ in range(8)]
        if i % 3 == 0:
            lines.insert(rng.randrange(8), f"Page {i} of 200 printed on 2024-01-{i % 28 + 1:02d} by user{i}")
        if i % 4 == 0:
            lines.insert(rng.randrange(8), "All rights reserved.")
        if i % 5 == 0:
            w = passage.split()
            w[rng.randrange(3, 60)] = word()
            lines.insert(rng.randrange(8), " ".join(w))
        texts.append("\n".join(lines))
    family = [texts[1]] * 6 + [texts[2].replace(texts[2].split()[40], "edited") for _ in range(4)]
    odd = [None, "", "\n\n \n", "All rights reserved.", "x " * 50000, "one\n" * 30]
    return texts + family + odd


def cleaned(spark, texts, start=0, parts=3, **options):
    df = spark.createDataFrame([(start + i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_lines string, tid int").repartition(parts)
    out = linededup.drop_recurring_lines(df, **options).orderBy("doc_id").collect()
    assert [r.doc_id - start for r in out] == list(range(len(texts)))
    return [r.text for r in out]


def test_op10_equals_plain_version(spark, tmp_path):
    texts = corpus()
    got = cleaned(spark, texts)
    assert len(check(texts, got)) == 3
    assert sum(w != t for w, t in zip(got, texts)) > 60
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text_sha256 for r in op10_template_line_dedup(spark, str(tmp_path)).collect()}
    assert rows == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(got)}


def test_ids_order_and_partitions_change_nothing(spark):
    texts = corpus()
    want = cleaned(spark, texts)
    assert cleaned(spark, texts, start=900, parts=5) == want
    back = cleaned(spark, texts[::-1], start=10**9, parts=1)
    assert back[::-1] == want


def test_nothing_vanishes_from_all_members_of_a_family(spark):
    rng = random.Random(6)
    p, q, r, s = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(4))
    texts = [f"{p}\n{q}", f"{p}\n{q}", f"{p}\n{r}", f"{q}\n{s}", f"{r}\nx y", f"{r}\nz", f"{s}\nu", f"{s}\nv"]
    for start in (0, 900, 1000):
        out = cleaned(spark, texts, start=start)
        check(texts, out)
        for line in (p, q, r, s):
            assert any(line in t for t in out)
    family = [f"{p}\n{q}\n{r} {k}x\n{s}" for k in range(12)]
    out = cleaned(spark, family)
    check(family, out)
    assert all(sum(x in t for t in out) == 1 for x in (p, q, s))


def test_clean_documents_are_left_alone(spark):
    texts = corpus()
    out = cleaned(spark, texts)
    assert out[120:126] == [texts[1]] * 6  # copies of one text are one holder
    for i in range(10, 120):
        if i % 3 and i % 4 and i % 5:
            assert out[i] == texts[i]
    assert sum("printed on" in t for t in out if t) == 1


def test_crowded_bands_give_the_same_result(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(12)] for _ in range(3)]
    texts = []
    for i in range(90):
        w = ["alpha", "beta", "gamma", *base[i % 3]]
        for _ in range(i % 4):
            w[rng.randrange(3, 15)] = word()
        texts.append(" ".join(w) + f"\n{word()} {word()} {word()} own line {'q' * i}")
    tiny, huge = (cleaned(spark, texts, max_group=g) for g in (2, 512))
    assert tiny == huge
    check(texts, huge)
    assert sum("alpha" in t for t in huge) < 30


def test_passages_leave_all_but_one_text(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(60)
    copy = prose(20) + "\n" + passage
    texts = [copy] * 4 + [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(2)]
    out = cleaned(spark, texts)
    check(texts, out)
    assert len({t for t in out if passage in t}) == 1 and all(t.split("\n")[0] == x.split("\n")[0] for t, x in zip(out, texts))


def test_op10_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op10_template_line_dedup(spark, str(tmp_path)).count() == 0
