"""Spelling variants: words one inserted, deleted or replaced character apart, grouped by deletion keys.

1. Words are counted in tasks before the shuffle; only distinct words go on.
2. For every word numpy takes polynomial hashes of all prefixes and suffixes (modulo 2**64, code points through a fixed
   mixing), and from them, without building a string, the hash of the word without each of its characters.
   *Replaced*: two words differ in place i only if they are equal without it, so their key is that hash with i.
   *Inserted*: the longer word without a character is the shorter; the key is the shorter's hash.  Of a run
   of equal characters only the first is left out, so a pair meets once.
3. Rows are dealt by the radix of their keys and sorted by key.  A group's words are checked on the strings, so a collision of hashes links nothing.
   A group answers for each of its words with the number of words near it and the best of them; pairs are never listed.
   A replaced group holds at most one word for each character of the alphabet, an inserted group one word and what one more character makes of it.
4. Spark sums these answers by word.  A word's form is its near word of largest count, if that is ``ratio`` times its own;
   roots follow by pointer doubling, as counts grow by ``ratio`` each step.

Defined cases: a null or empty text has no words; rows that repeat count each by itself; ties go to the word that is smaller in code points;
an empty table gives no rows; a word without near words has ``n_near`` 0, no form, and is its own root; other columns don't travel along.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import checkpointed, only, written

RUN = r"[A-Za-zÀ-ÿ]+"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 20_000  # characters of words whose keys are made at once
ROWS = 50_000


def thinned(doc_id: int | None, run: str, every: int = 31) -> str:
    """The run without one character, for one in ``every`` pairs of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[: (k := h % len(run))] + run[k + 1 :]


def word_counts(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", least_size: int = 7, change: Callable[[int | None, str], str] | None = None, max_words: int = 300_000) -> DataFrame:
    """``word`` and ``n``: runs of letters of ``least_size`` code points or more, A-Z lower-cased, as ``change`` leaves them in their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = re.compile(RUN[:-1] + "{%d,}" % least_size), Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(pattern.findall((text.as_py() or "").encode().lower().decode()))
                if change:
                    for word, n in found.items():
                        seen[change(doc, word)] += n
                else:
                    seen.update(found)
                if len(seen) > max_words:
                    yield from _counted(seen)
                    seen.clear()
        yield from _counted(seen)

    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).mapInArrow(run, "word string, n long")
    return rows.where(F.length("word") >= least_size).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    words, n = list(seen), list(seen.values())
    for i in range(0, len(words), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(words[i : i + ROWS], pa.string()), pa.array(n[i : i + ROWS], pa.int64())], ["word", "n"])


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, place and key of every row that the words deal.  The place is -1 for a word itself, i for the word without its
    i-th character, and -2 - i for the same where the character starts a run of equal ones (the key of an inserted character)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - begin[owner]
    up, down = powers(BASE, int(size.max())), powers(INVERSE, int(size.max()))
    term = mixed(code + np.uint64(1)) * up[place]  # c_i B^i
    total = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
    prefix = total[:-1] - total[begin[owner]]  # of the characters before i
    suffix = (total[(begin + size)[owner]] - total[1:]) * down[1]  # of those after i, moved one place down
    whole = total[begin + size] - total[begin]
    gone = prefix + suffix
    first = (place == 0) | (code != np.r_[np.uint64(0), code[:-1]])
    at = np.r_[np.full(len(words), -1), place, -2 - place[first]]
    of = np.r_[np.arange(len(words)), owner, owner[first]]
    h = np.r_[whole, gone, gone[first]]
    key = mixed(h + mixed(np.where(at >= 0, at + 1, 0).astype(np.uint64)))
    return of, at, key.view(np.int64)


def shared_keys(words: DataFrame, radix_bits: int) -> DataFrame:
    """``key``, ``at`` and ``wid`` of the rows whose key another row has too.  No string is in them: a word of a million
    characters deals as many rows, and only what has company is looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                size = np.cumsum([len(w) for w in batch.column(0).to_pylist()])
                cuts = np.unique(np.r_[0, np.searchsorted(size, np.arange(BLOCK, size[-1] if len(size) else 0, BLOCK)), batch.num_rows])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    of, at, key = deletion_keys(batch.column(0).slice(a, b - a).to_pylist())
                    own = batch.column(1).slice(a, b - a)
                    for i in range(0, len(of), ROWS):
                        s = slice(i, i + ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(at[s].astype(np.int32)), own.take(pa.array(of[s]))], ["key", "at", "wid"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether its key repeats
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            keep[0] |= held is not None and held[1]
            held = batch.slice(len(key) - 1), bool(keep[-1])
            yield batch.filter(pa.array(np.r_[keep[:-1], False]))
        if held is not None and held[1]:
            yield held[0]

    rows = words.select("word", "wid").mapInArrow(run, "key long, at int, wid long")
    return by_radix(rows, radix_bits).mapInArrow(repeated, "key long, at int, wid long")


def by_radix(rows: DataFrame, bits: int) -> DataFrame:
    return rows.repartition(F.shiftrightunsigned("key", 64 - bits)).sortWithinPartitions("key")


def answers(group: list[tuple[int, str, int]], out: list[tuple]) -> None:
    """Add (word, near words, the best of them, its count) for the words of one key: (place, word, n)."""
    by: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for at, word, n in group:  # the strings decide, whatever the hash says
        left = word if at == -1 else word[: (i := at if at >= 0 else -2 - at)] + word[i + 1 :]
        by.setdefault((max(at, -1), left), []).append((-n, word))
    for (at, left), members in by.items():
        if len(members) < 2:
            continue
        if at >= 0:
            (n1, best), (n2, second) = sorted(members)[:2]
            out += [(w, len(members) - 1, *((second, -n2) if w == best else (best, -n1))) for _, w in members]
        else:
            short = [m for m in members if m[1] == left]
            longer = [m for m in members if m[1] != left]
            if short and longer:
                n, best = min(longer)
                out.append((left, len(longer), best, -n))
                out += [(w, 1, left, -short[0][0]) for _, w in longer]


def near_words(words: DataFrame, *, radix_bits: int = 16) -> DataFrame:
    """``word``, ``n_near``, ``best`` and ``best_n`` of every word that has a near one."""
    words = written(words.select("word", "n", F.monotonically_increasing_id().alias("wid")))
    rows = by_radix(shared_keys(words, radix_bits).join(words, "wid").select("key", "at", "word", "n"), radix_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, out = None, []
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on
            rest = table.slice(last).to_batches()[0]
            yield from grouped(table.slice(0, last), key[:last], out)
        if rest is not None:
            yield from grouped(pa.Table.from_batches([rest]), rest.column(0).to_numpy(), out)
        yield from _answers(out)

    def grouped(table: pa.Table, key: np.ndarray, out: list[tuple]) -> Iterator[pa.RecordBatch]:
        edge = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, int)
        many = np.flatnonzero(np.diff(edge) > 1)
        inside = np.concatenate([np.arange(edge[m], edge[m + 1]) for m in many]) if len(many) else np.zeros(0, int)
        at, word, n = (table.column(c).take(pa.array(inside)).to_pylist() for c in ("at", "word", "n"))
        rows, start = list(zip(at, word, n, strict=True)), 0
        for size in np.diff(edge)[many].tolist():
            answers(rows[start : start + size], out)
            start += size
            if len(out) > ROWS:
                yield from _answers(out)
                out.clear()

    found = rows.mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def _answers(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        word, near, best, n = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best, pa.string()), pa.array(n, pa.int64())], ["word", "n_near", "best", "best_n"])


def roots(words: DataFrame) -> DataFrame:
    """``words`` (``word``, ``form``) with ``root``: the last form, by doubling the distance looked ahead."""
    step = checkpointed(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return words.join(step.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        step = step.drop("moved")


def spelling_groups(words: DataFrame, *, ratio: int = 10, least: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` for every word of ``words`` (``word``, ``n``) with ``least`` occurrences."""
    words = written(only(words, "word", "n").where((F.col("n") >= least) & (F.length("word") > 0)))
    rows = words.join(near_words(words), "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")))
    return roots(rows).select("word", "form", "root", "n", "n_near", "form_n")
