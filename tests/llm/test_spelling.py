"""Spelling groups against comparing all words."""

import random
import re
import zlib
from collections import Counter

from lexivec.llm import spelling
from lexivec.llm.queries import op11_spelling_groups
from given_tables import DIR, rows


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(docs):
    seen = Counter()
    for i, text in docs:
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return seen


def plain(seen, ratio=10, least=2):
    n = {w: k for w, k in seen.items() if k >= least}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, around = {}, {}
    for w in n:
        others = [v for d in (-1, 0, 1) for v in by_size.get(len(w) + d, ()) if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w], around[w] = best if best and n[best] >= ratio * n[w] else None, len(others)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], around[w], n.get(form[w])))
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_op11_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    got = op11_spelling_groups(spark, DIR)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(counts(docs))
    assert any(r[1] for r in want) and collected(got) == want


def words_around(rng):
    seen = Counter()
    for _ in range(30):
        word = "".join(rng.choices("abé", k=rng.randint(1, 9)))
        seen[word] += rng.choice([2, 30, 4000])
        for _ in range(8):
            k = rng.randrange(len(word) + 1)
            seen[rng.choice([word[:k] + rng.choice("abéß") + word[k:], word[:k] + rng.choice("ab") + word[k + 1 :], word[:k] + word[k + 1 :]])] += rng.choice([1, 2, 3, 40])
    return Counter({w: n for w, n in seen.items() if w})


def test_groups_of_made_words(spark):
    seen = words_around(random.Random(11))
    long = "q" * 30_000
    seen.update({long: 900, long + "q": 50, long[:-1]: 3, "r" + long: 4, long[:900] + "x" + long[901:]: 5, "😀😀😀": 2, "😀😀": 70})
    df = spark.createDataFrame([(w, n, "clash") for w, n in seen.items()], "word string, n long, root string").repartition(3)
    assert collected(spelling.spelling_groups(df)) == plain(seen)


def test_strings_decide_where_keys_collide():
    seen = {w: n for w, n in words_around(random.Random(5)).items() if len(w) > 1}
    names, found, total = list(seen), [], Counter()
    of, at, _ = spelling.deletion_keys(names)
    spelling.answers([(int(a), names[o], seen[names[o]]) for o, a in zip(of, at, strict=True)], found)
    for word, n, _, _ in found:
        total[word] += n
    assert {w: total[w] for w in seen} == {w: sum(near(w, v) for v in seen) for w in seen}


def test_keys_are_hashes_of_the_rest():
    words = ["abcabc", "é", "aab", "ab", "xabcabc"]
    of, at, key = spelling.deletion_keys(words)
    found = {(words[o], int(a)): int(k) for o, a, k in zip(of, at, key, strict=True)}
    assert found["aab", -2] == found["ab", -1] and found["xabcabc", -2] == found["abcabc", -1]
    assert ("aab", -3) not in found and found["aab", 0] != found["aab", 1]
    assert len({k for (w, a), k in found.items() if w == "abcabc" and a >= 0}) == 6


def test_edges(spark):
    schema = "doc_id long, text string, word string"
    assert op_of(spark, [], schema) == []
    texts = [(1, None, "x"), (2, "", "x"), (3, "short words only", "x"), (None, "Wörterbuch wörterbuch", "x"), (4, "abcdefgh " * 50, "x"), (4, "abcdefgh " * 50, "x"), (5, "abcdefgi", "x"), (6, "ABCDEFGI ÀBCDEFGH àbcdefgh àbcdefgh", "x")]
    assert op_of(spark, texts, schema) == plain(counts([(i, t) for i, t, _ in texts]))


def op_of(spark, texts, schema):
    docs = spark.createDataFrame(texts, schema)
    return collected(spelling.spelling_groups(spelling.word_counts(docs, change=spelling.thinned)))


def test_chain_of_forms(spark):
    seen = Counter({"aaaaaaaa" + "b" * k: 10**k for k in range(1, 9)})
    df = spark.createDataFrame(list(seen.items()), "word string, n long")
    got = collected(spelling.spelling_groups(df))
    assert got == plain(seen) and {r[2] for r in got} == {"aaaaaaaabbbbbbbb"}
