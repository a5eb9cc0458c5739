"""BPE and packing against the tokenizers library and plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexivec.llm import bpe, packing
from lexivec.llm.queries import op1_bpe_transducer, op7_best_fit_packing, vocabulary

CASES = [
    None, "", " ", "\n\n  \t x", "the the the don't we'll I'M 'reply ''s x's", "aaaaaaaaaaaaaaaaaaaaaaaa" * 30,
    "<|endoftext|>a<|endoftext|><|endoftext|> b", "ÄÖ straße naïve 한국어 日本語 \U0001f600\U0001f9d1‍\U0001f680 é", "1234 5678x9", "x" * 5000,
    "\x1c\x1d\x85\xa0 　 a", "the quick brown fox " * 2000, "the", "the",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def table(spark, texts, folder):
    rows = [(i, t, "clash", -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_op1_equals_library(spark, tmp_path, library):
    random.seed(5)
    points = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F400)] + [*bpe.newer_characters()[::40]]
    texts = CASES + ["".join(random.choice(points) + random.choice(["", " ", "a", "1", "'s"]) for _ in range(60)) for _ in range(80)]
    got = {r.doc_id: r for r in op1_bpe_transducer(spark, table(spark, texts, tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_empty_table(spark, tmp_path):
    assert op1_bpe_transducer(spark, table(spark, [], tmp_path)).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: np.array([i, i + 1], np.int32).tobytes() for i, w in enumerate([b"cats", b"dogs", b"cat", b"dog", b"bats", b"bat"])}
    path = tmp_path / "x.bin"
    path.write_bytes(bpe.compile_lexicon(words))
    lex = bpe.Lexicon(str(path))
    assert lex.find([*words, b"ca", b"catsx", b"", b"zz"]) == [*words.values(), None, None, None, None]
    # The start, c|b, ca|ba, d, do, t|g, and the end after s.
    assert len(lex.final) == 7


def test_merge_in_step_equals_heap(library):
    vocab = bpe.Vocabulary(vocabulary())
    random.seed(1)
    words = ["".join(random.choice("abcdethionrs ") for _ in range(random.randint(2, 40))).encode() for _ in range(300)]
    assert vocab.merge(words) == [vocab._merge_long(w) for w in words]


def plain_pieces(library, texts, capacity=2048):
    out = {}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        first = n if n <= capacity else (n % capacity or capacity)
        edges = [0, *range(first, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out[i, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    return out


def test_op7_pieces_and_bins(spark, tmp_path, library):
    random.seed(2)
    texts = CASES + ["word " * random.randint(0, 3000) for _ in range(150)]
    rows = op7_best_fit_packing(spark, table(spark, texts, tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(library, texts)
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows})
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(bins) <= least * 1.05 + 1


def test_op7_empty_table(spark, tmp_path):
    assert op7_best_fit_packing(spark, table(spark, [], tmp_path)).count() == 0


def test_best_fit_prefers_fullest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1]
    assert offsets.tolist() == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, "a b <|endoftext|> " + " " * 1_000_000 + "é", "\r\n" * 600_000])
def test_long_white_space(library, text):
    ids = packing.encoded(packing.tokenizer(vocabulary()), vocabulary(), text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
