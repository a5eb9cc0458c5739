"""SimHash links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from lexivec.llm import simhash
from lexivec.llm.queries import op8_simhash_components


def plain_fingerprint(text, k=3):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", data) if w]
    s = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(prints, ids, budget=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta Gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n)) for n in (300, 200, 120, 60, 5)]
    out = [None, "", " \n", "one", "ONE two", "ÄB äb c d", base[0], base[0].upper(), "x " * 20000]
    for b in base:
        for _ in range(40):
            w = b.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 5)
            out.append(" ".join(w))
    return out


def test_op8_equals_all_pairs(spark, tmp_path):
    t = texts()
    ids = [*range(100, 100 + len(t) - 2), None, 100]
    rows = [(i, x, "clash", 7, "clash") for i, x in zip(ids, t)]
    spark.createDataFrame(rows, "doc_id long, text string, sig string, component_id int, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_simhash_components(spark, str(tmp_path)).collect()
    prints = [plain_fingerprint(x) for x in t]
    want = sorted(map(str, zip(ids, [format(p, "016x") for p in prints], plain_components(prints, ids))))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_op8_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op8_simhash_components(spark, str(tmp_path)).count() == 0


def test_crowded_nodes_lose_no_link(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**62), 2**62, 6)
    prints = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 4)).tolist()) if x < 63) for b in base for _ in range(60)]
    df = spark.createDataFrame([([p],) for p in sorted(set(prints))], "sig array<long>")
    unsigned = [p & (2**64 - 1) for p in sorted(set(prints))]
    want = plain_components(unsigned, unsigned)
    for max_node in (10, 1000):
        links = simhash.trie_links(df, bits=64, budget=3, tables=simhash.blocks(64, 16), max_node=max_node)
        found = {r.v[0] & (2**64 - 1): r.root[0] & (2**64 - 1) for r in simhash.components(links).collect()}
        groups, plain = {}, {}
        for u, w in zip(unsigned, want):
            groups.setdefault(found.get(u, u), set()).add(u)
            plain.setdefault(w, set()).add(u)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_deduplicated_links_at_the_contract_and_not_below(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, near = [], set()
    for i in range(80):
        w = [word() for _ in range(404)]
        m = 44 if i % 2 else 49  # of 400 five-word shingles as many differ: a similarity of 0.802 or 0.782
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-m] + [word() for _ in range(m)]))]
        if i % 2:
            near.add(2 * i + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert gone <= near and len(gone) >= 39


def brute_groups(sig, budget):
    n = len(sig)
    near = np.array([[int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= budget for j in range(n)] for i in range(n)])
    root = np.arange(n)
    while True:
        low = np.array([root[near[i]].min() for i in range(n)])
        if (low == root).all():
            return root
        root = low


@pytest.mark.parametrize("words,budget,flips", [(1, 3, 3), (1, 3, 40), (8, 77, 40), (8, 77, 300)])
@pytest.mark.parametrize("last", [0, 1])
def test_forest_equals_all_pairs(words, budget, flips, last):
    """One node of 2 to 300 signatures, dense or random; the last node in row order is empty or not on either side."""
    rng = np.random.default_rng([words, flips, last])
    for n in (2, 3, 6, 7, 31, 33, 60, 300):
        bit = rng.integers(0, 2, (max(1, n // 20), 64 * words)).astype(np.uint8)[rng.integers(0, max(1, n // 20), n)]
        for row in bit:
            row[rng.integers(0, 64 * words, rng.integers(0, flips + 1))] ^= 1
        bit[:, :16] = last  # an empty sibling before or after the node
        sig = np.unique(np.packbits(bit, axis=1).view(">u8").astype(np.uint64), axis=0)
        whole = np.array([0]), np.array([len(sig)])
        comp, a, b = simhash.forest(sig, *whole, *whole, budget)
        assert (np.bitwise_count(sig[a] ^ sig[b]).sum(1) <= budget).all()
        want = brute_groups(sig, budget)
        assert [sorted(np.flatnonzero(comp == c)) for c in np.unique(comp)] == [sorted(np.flatnonzero(want == c)) for c in np.unique(want)]
        assert len(a) == len(sig) - len(np.unique(want))
        _, a, b = simhash.forest(sig, *whole, *whole, budget, every=True)
        pairs = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
        assert len(pairs) == sum(int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= budget for i in range(len(sig)) for j in range(i))


def test_forest_of_two_nodes_and_a_crowd():
    rng = np.random.default_rng(5)
    sig = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64)[:, None], axis=0)
    half = len(sig) // 2
    comp, a, b = simhash.forest(sig, np.array([0]), np.array([half]), np.array([half]), np.array([len(sig)]), 18)
    near = np.bitwise_count(sig[:half] ^ sig[half:].T) <= 18
    assert {(i, j + half) for i, j in zip(*np.nonzero(near))} >= {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())}
    i, j = np.nonzero(near)
    assert (comp[i] == comp[j + half]).all()


def test_deduplicated_is_the_same_however_blocks_are_cut(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(80):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted(i for i in range(len(rows)) if root[i] == i)
    cut, whole = (sorted(r.doc_id for r in simhash.deduplicated(df, max_node=m).collect()) for m in (8, 200_000))
    assert cut == whole
    assert set(want) <= set(whole) and len(whole) <= 1.05 * len(want)  # no false link; few of these short texts are missed


def test_deduplicated_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", 1), (1, text, "b", 2), (2, text.upper(), "c", 3), (3, "other words " * 9, "d", 4), (3, "other words " * 9, "d", 4), (None, text, "e", 5), (4, None, "f", 6), (5, "", "g", 7), (6, "alone", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string, n int")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 6]
