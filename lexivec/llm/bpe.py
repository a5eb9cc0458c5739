"""Byte-level BPE over a minimal acyclic transducer lexicon.

1. A Spark job counts the words (pre-tokens) of all texts; the ``lexicon_words`` most
   frequent of up to ``MAX_WORD`` bytes come to the driver, a bound that does not grow with the input.
2. The driver merges those words once and compiles them into a minimal acyclic
   transducer: equal suffixes share states, every transition carries a number, and the sum of
   the numbers along a word's path is its place in the table of id sequences.
3. The compiled file goes to every executor with ``addFile``; tasks memory-map it, so
   the workers of a machine share its pages.
4. Tasks split texts into words, walk all new words of a batch through the
   transducer at once, and merge the words it doesn't hold exactly by the merge table.

Defined cases: a null text is encoded as the empty text (no ids); the strings of
added tokens (``<|endoftext|>``) in a text become their own id, as in the
tokenizers library; long texts are never cut; repeated rows are encoded each by itself;
an empty table gives an empty result; columns not named in ``keep`` don't travel along.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from lexivec.llm.common import shared_folder, written

MAX_WORD = 48
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: token bytes, merges and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(symbols[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.base = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.base[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pair_rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        # The same as a hash table for numpy: a pair lies at its slot or in the next ones, before an empty one.
        self.bits = max(8, 2 + len(pairs).bit_length())
        self.slots = np.full((1 << self.bits) + len(pairs), -1, np.int64)
        self.ranks_at = np.full(len(self.slots), NONE)
        for (left, right), rank in self.pair_rank.items():
            key = left * self.size + right
            at = self._slot(key)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.ranks_at[at] = key, rank

    def _slot(self, key):
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs, ``NONE`` where a pair doesn't merge."""
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        out = np.where(self.slots[at] == key, self.ranks_at[at], NONE)
        rest = np.flatnonzero((self.slots[at] >= 0) & (self.slots[at] != key))
        while len(rest):
            at[rest] += 1
            held = self.slots[at[rest]]
            hit = held == key[rest]
            out[rest[hit]] = self.ranks_at[at[rest[hit]]]
            rest = rest[(held >= 0) & ~hit]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian int32 bytes; all short words merge in step."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= 256]
        for i, w in enumerate(words):
            if len(w) > 256:
                out[i] = self._merge_long(w)
        if not short:
            return out
        ids = self.base[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        count = np.array([len(words[i]) for i in short])
        owner = np.array(short)
        rank = np.full(len(ids), NONE)  # of the pair that begins here
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[np.cumsum(count) - 1] = NONE
        while len(owner):
            first = np.cumsum(count) - count
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == NONE
            if done.any():
                data = ids.tobytes()
                for w, a, n in zip(owner[done].tolist(), first[done].tolist(), count[done].tolist(), strict=True):
                    out[w] = data[4 * a : 4 * (a + n)]
                stay = np.repeat(~done, count)
                ids, rank, owner, count, lowest = ids[stay], rank[stay], owner[~done], count[~done], lowest[~done]
            # Merges of one rank happen at once; of overlapping pairs (aaa) every second one from the left.
            at = np.flatnonzero(rank == np.repeat(lowest, count))
            if not len(at):
                break
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            word = np.repeat(np.arange(len(count)), count)
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            count = count - np.bincount(word[at], minlength=len(count))
            ids, rank, word = ids[keep], rank[keep], word[keep]
            at -= np.arange(len(at))  # the places of the merged tokens now
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            fresh = fresh[fresh < len(ids) - 1]
            rank[fresh] = np.where(word[fresh] == word[fresh + 1], self.ranks(ids[fresh], ids[fresh + 1]), NONE)
            rank[np.cumsum(count) - 1] = NONE
        return out

    def _merge_long(self, word: bytes) -> bytes:
        """One word: all merges of the lowest rank at once while they are many (runs of one character), then by a heap of pairs, in n log n."""
        ids = self.base[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self.ranks(ids[:-1], ids[1:])
            at = np.flatnonzero(rank == rank.min())
            if 32 * len(at) < len(ids) or rank[at[0]] == NONE:
                break
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            ids[at] = self.merged[rank[at]]
            ids = np.delete(ids, at + 1)
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [(int(r), i) for i, r in enumerate(self.ranks(ids[:-1], ids[1:])) if r != NONE]
        heapq.heapify(heap)
        ids, table = ids.tolist(), self.pair_rank
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or table.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := table.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()


@cache
def vocabulary_at(path: str) -> Vocabulary:
    """Read once in a worker process."""
    return Vocabulary(path)


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """A minimal acyclic transducer of ``words`` (to int32 id bytes) as one block of int32 arrays.

    Words are added in order; when a branch can't grow any more its states are
    replaced by registered equal ones, so suffixes are shared as they are built."""
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []  # of each registered state: byte, target
    final: list[bool] = []
    reach: list[int] = []  # words below each state
    path: list[list] = [[False, []]]  # the states along the last word: is final, edges
    last = b""

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            end, out = path.pop()
            key = (end, *out)
            if key not in register:
                register[key] = len(edges)
                edges.append(tuple(out))
                final.append(end)
                reach.append(end + sum(reach[t] for _, t in out))
            path[-1][1].append((last[len(path) - 1], register[key]))

    ordered = sorted(w for w in words if w)
    for w in ordered:
        same = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
        close(same)
        path += [[False, []] for _ in w[same:]]
        path[-1][0], last = True, w
    close(0)
    root = len(edges)
    edges.append(tuple(path[0][1]))
    final.append(False)
    rows = []
    for state, out in enumerate(edges):
        skipped = int(final[state])
        for byte, target in out:
            rows.append((state << 8 | byte, target, skipped))
            skipped += reach[target]
    table = np.array(sorted(rows), np.int32).reshape(-1, 3)
    ids = [np.frombuffer(words[w], np.int32) for w in ordered]
    start = np.cumsum([0, *map(len, ids)])
    parts = [table[:, 0], table[:, 1], table[:, 2], np.array(final), start, np.concatenate([*ids, np.zeros(0, np.int32)])]
    return np.concatenate([np.array([root, *map(len, parts)]), *parts]).astype("<i4").tobytes()


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i4", mode="r")
        at = 7
        parts = []
        for n in data[1:7].tolist():
            parts.append(data[at : at + n])
            at += n
        self.root = int(data[0])
        self.keys, self.targets, self.steps, self.final, self.start, self.ids = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, or None where the lexicon doesn't hold it; all words walk in step."""
        out: list[bytes | None] = [None] * len(words)
        rows = np.array([i for i, w in enumerate(words) if 0 < len(w) <= MAX_WORD], np.int64)
        if not len(rows) or not len(self.keys):
            return out
        size = np.array([len(words[i]) for i in rows])
        text = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        begin = np.cumsum(size) - size
        state, place = np.full(len(rows), self.root), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for step in range(MAX_WORD):
            key = (state[live] << 8) | text[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            place[live] += self.steps[at]
            live = live[size[live] > step + 1]
            if not len(live):
                break
        held = np.flatnonzero((state >= 0) & (self.final[state] > 0))
        for i, a, b in zip(rows[held], self.start[place[held]], self.start[place[held] + 1], strict=True):
            out[i] = self.ids[a:b].tobytes()
        return out


@cache
def newer_characters() -> list[str]:
    """Letters and digits by this regex library's Unicode version that are none yet by
    that of the tokenizers library; found by asking both about what Python calls unassigned."""
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    mine = regex.compile(r"[\p{L}\p{N}]").match
    unsure = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    unsure = [c for c in unsure if unicodedata.category(c) == "Cn" and mine(c)]
    return [c for c in unsure if len(split("!" + c)) == 1]


def ranges(characters: Iterable[str]) -> str:
    """The inside of a character class for sorted characters."""
    runs: list[list[str]] = []
    for c in characters:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{a}-{b}" for a, b in runs)


@cache
def patterns() -> tuple:
    """The splitter of words, a search for what may be newer characters, and the splitter of texts that hold them."""
    new = newer_characters()
    rare = f"[{ranges(new)}]"
    strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{rare})")
    strict = strict.replace(r" ?\p{L}+", rf" ?[\p{{L}}--{rare}]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--{rare}]+")
    maybe = re.compile(f"[{ranges(c for c in new if c < chr(0x10000))}{chr(0x10000)}-{chr(0x10FFFF)}]")
    return regex.compile(PATTERN).findall, maybe.search, regex.compile("(?V1)" + strict).findall


def split_words(texts: Iterable[str], added: Iterable[str] = ()) -> Iterator[list[str]]:
    """The pre-tokens of each text; added tokens stand by themselves."""
    usual, newer, strict = patterns()
    added = list(added)
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    for text in texts:
        words = strict if not text.isascii() and newer(text) else usual
        if special and any(a in text for a in added):
            yield [w for part in special.split(text) for w in ([part] if part in added else words(part))]
        else:
            yield words(text)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n`` over all texts; each task sums up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for words in split_words(x or "" for x in batch.column(0).to_pylist()):
                seen.update(words)
            if len(seen) > 300_000:
                yield from _counts(seen)
                seen.clear()
        yield from _counts(seen)

    part = docs.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter) -> Iterator[pa.RecordBatch]:
    words, n = list(seen), list(seen.values())
    for i in range(0, len(words), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000]), pa.array(n[i : i + 20_000], pa.int64())], ["word", "n"])


_FILES: set[str] = set()  # lexicons that this process has written


def publish_lexicon(docs: DataFrame, vocab_path: str, *, text: str = "text", lexicon_words: int = 196_608) -> str:
    """Compile the most frequent words of ``docs``, give the file to all executors, return its name there.

    The words are those of a count or more, the smallest such count (in steps of a few per cent) that leaves at most
    ``lexicon_words``; so no task sends more than its share of them."""
    counts = written(word_counts(docs, text).where(F.octet_length("word").between(1, MAX_WORD)))
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 32) - 128)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # some thousand rows at most
        held += r.words
        if held > lexicon_words:
            break
        least = r.n
    frequent = counts.where(F.col("n") >= least if least else F.lit(False))
    words = [r.word.encode() for r in frequent.select("word").collect()]  # at most lexicon_words rows
    blob = compile_lexicon(dict(zip(words, Vocabulary(vocab_path).merge(words), strict=True)))
    name = f"lexicon-{hashlib.sha256(blob).hexdigest()[:24]}.bin"
    folder = shared_folder(docs.sparkSession).rstrip("/")
    if f"{folder}/{name}" not in _FILES:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(blob)
        _FILES.add(f"{folder}/{name}")
    docs.sparkSession.sparkContext.addFile(f"{folder}/{name}")  # every executor fetches it once, late ones too
    return name


def encode(
    docs: DataFrame, vocab_path: str, lexicon: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids"
) -> DataFrame:
    """``keep`` and an ``array<int>`` of token ids for every row."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = vocabulary_at(vocab_path), Lexicon(SparkFiles.get(lexicon))
        special = {k: np.int32(v).tobytes() for k, v in vocab.added.items()}
        known: dict[str, bytes] = {}
        for whole in batches:
            for batch in pieces(whole):
                lists = list(split_words((x or "" for x in batch.column(-1 + batch.num_columns).to_pylist()), vocab.added))
                if len(known) > 300_000:
                    known.clear()
                known.update(special)
                new = list(set().union(*lists) - known.keys())
                raw = [w.encode() for w in new]
                found = lex.find(raw)
                unseen = [i for i, x in enumerate(found) if x is None]
                for i, x in zip(unseen, vocab.merge([raw[i] for i in unseen]), strict=True):
                    found[i] = x
                known.update(zip(new, found, strict=True))
                coded = [b"".join(map(known.__getitem__, words)) for words in lists]
                offsets = np.cumsum([0, *(len(c) // 4 for c in coded)])
                values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], ids])

    return frame.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "decoded") -> DataFrame:
    """``keep`` and the text of every row's ids; bytes that aren't UTF-8 become U+FFFD, null ids a null text."""
    frame = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{ids}`").alias("_ids"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_at(vocab_path).tokens
        for whole in batches:
            for batch in pieces(whole, 200):
                column = batch.column(batch.num_columns - 1)
                flat = column.flatten().to_numpy().tolist()
                size = column.value_lengths().to_pylist()  # None of a null
                ends = np.cumsum([n or 0 for n in size]).tolist()
                texts = [
                    None if n is None else b"".join(map(tokens.__getitem__, flat[e - n : e])).decode("utf-8", "replace")
                    for n, e in zip(size, ends, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], text])

    return frame.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, for bounded memory."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
