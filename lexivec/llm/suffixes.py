"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier are removed.

1. *Dealing.*  Every string of ``length`` bytes has an anchor: the ``gram`` bytes inside it with the smallest hash (the first of
   equal ones).  Equal strings have equal anchors.  Consecutive strings with one anchor form a segment, about a third of
   which is context, and segments are dealt by their anchor, so no suffix needs more text than its segment.
   Anchors that occur once have no company and aren't dealt; equal segments of a task's slice are dealt once, by the earliest.
2. *Two-stage sorting.*  A task concatenates the different segments of its anchors, block by block.  Suffixes smaller than
   their successors are sorted directly, eight bytes at a time, as far as ``length`` bytes; all others are induced by one scan over the buckets of first
   bytes: what precedes a bucket's sorted suffixes falls, in their order, into the buckets of the preceding bytes.
3. Adjacent suffixes whose common prefix reaches ``length`` bytes form runs.  All but the earliest of a run repeat.
4. Repeating strings are gathered by document, and the bytes that they cover are removed.

An anchor with more than ``max_group`` different segments is dealt by longer strings: those of its strings that reach half of the missing
bytes to the left go by the anchor with these bytes, the others by the anchor with the bytes to the right, again and
again until the groups are small or the strings whole; equal segments are counted before each step.

"Earlier" is by id (nulls first), then by a hash of the text, then by start.  Defined cases: a null text stays null and
counts as empty; rows that repeat id and text are one document, and all are given its result; a text shorter than ``length`` loses nothing; bytes that
remain of a cut character become U+FFFD in ``text`` (``kept`` holds the bytes themselves); an empty table gives
no rows; clashing columns of the input are kept, the operator's own begin with ``_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import likely_in, spread, written

SLICE = 4 << 20  # bytes of text that are cut into segments at once
STRETCH = 1 << 17  # bytes of a slice whose anchors are looked for at once
SEGMENTS = 1 << 18  # segments of a slice that are compared at once: all, unless it repeats one letter or the like
ROWS = 1 << 14  # segments that are held as Python objects, and passed on, at once
BLOCK = 1 << 20  # bytes of segments that are sorted at once
FILTER_WORDS = 1 << 20  # longs in the bitmap of shared anchors
PLACE = np.uint64((1 << 24) - 1)
ITEM = "key long, id long, h long, start long, n long, a int, b int, body binary"
NO_ID = -(1 << 63)
REPEAT = "id long, h long, start long, n long"


def words_at(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    w = np.r_[x, np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(x)]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of eight) from each place on."""
    w = words_at(x)
    n = len(x) - gram + 1
    h = np.zeros(n, np.uint64)
    for i in range(0, gram, 8):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(x: np.ndarray, inside: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings, place of the anchor and its hash, of every segment of a buffer.
    ``inside`` tells for each place whether the string from there on is of one document."""
    found, before = [], -1
    for low in range(0, len(inside), STRETCH):
        here = inside[low : low + STRETCH]
        h = gram_hashes(x[low : low + len(here) + length - 1], gram)
        best = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = np.where(here, low + (best & PLACE).astype(np.int64), -1)
        first = np.flatnonzero(anchor != np.r_[before, anchor[:-1]])  # a segment may go on from the last stretch
        before = anchor[-1]
        key = h[np.maximum(anchor[first] - low, 0)].view(np.int64)
        found.append(((low + first).astype(np.int32), anchor[first].astype(np.int32), key))
    first, anchor, key = map(np.concatenate, zip(*found, strict=True))
    n = np.diff(np.r_[first, len(inside)]).astype(np.int64)
    return tuple(c[anchor >= 0] for c in (first, n, anchor, key))


def slices(batches: Iterator[pa.RecordBatch], length: int, piece: int) -> Iterator[list[tuple[int | None, int, int, bytes]]]:
    """Texts as lists of (id, h, start, bytes) of about ``piece`` bytes; long texts in parts that share ``length - 1`` bytes."""
    held: list[tuple[int | None, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for doc, h, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            for start in range(0, max(len(raw) - length + 1, 0), piece):
                held.append((doc.as_py(), h.as_py(), start, raw[start : start + piece + length - 1]))
                size += len(held[-1][3])
                if size >= piece:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def cut(parts: list[tuple[int | None, int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The joined buffer of a slice; for every segment the part, start in it, number of strings, anchor's place in the segment, key."""
    x = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    size = np.array([len(p[3]) for p in parts])
    begin = np.cumsum(size) - size
    strings = np.stack([size - length + 1, np.full(len(parts), length - 1)], axis=1).ravel()  # inside a part, and beyond its end
    inside = np.repeat(np.tile([True, False], len(parts)), strings)[: len(x) - length + 1]
    with np.errstate(over="ignore"):
        first, n, anchor, key = segments(x, inside, length, gram)
    owner = np.searchsorted(begin, first, side="right") - 1
    return x, owner, first, n, anchor - first, key, first - begin[owner]


def anchors(rows: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """``key`` and ``k``, in how many segments it is the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in slices(batches, length, piece):
            key, k = np.unique(cut(parts, length, gram)[5], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(k)], ["key", "k"])

    return rows.mapInArrow(run, "key long, k long").groupBy("key").agg(F.sum("k").alias("k"))


def repeats(group: np.ndarray, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in groups: whether a row is not its group's earliest, and the index of that earliest row.  ``identity``
    has id, hash and start in its rows; a row that has the same as the earliest is the earliest, too."""
    order = np.lexsort([*identity[::-1], group])
    first = np.r_[True, group[order[1:]] != group[order[:-1]]]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return (identity != identity[:, lead]).any(0), lead


def dealt(rows: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """``ITEM`` rows: segments of ``n`` strings from ``start`` on that share the bytes ``a`` to ``b`` of ``body``.
    Of equal segments of one slice only the earliest has a body; the others are known to repeat."""
    names = [c.split(" ")[0] for c in ITEM.split(", ")]

    def distinct(raw: bytes, identity: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        end = first + n + length - 1
        _, group, k = np.unique(key, return_inverse=True, return_counts=True)
        several = np.flatnonzero(k[group] > 1)  # equal segments have equal anchors
        seen: dict[bytes, int] = {}
        for low in range(0, len(several), ROWS):
            at = several[low : low + ROWS]
            group[at] = [len(k) + seen.setdefault(raw[i:j], len(seen)) for i, j in zip(first[at].tolist(), end[at].tolist(), strict=True)]
        again, lead = repeats(group, identity)
        leads = lead == np.arange(len(n))
        wanted = np.flatnonzero(again | leads)  # rows that repeat id and text are one document
        for low in range(0, len(wanted), ROWS):
            at = wanted[low : low + ROWS]
            body = [raw[i:j] if one else None for i, j, one in zip(first[at].tolist(), end[at].tolist(), leads[at].tolist(), strict=True)]
            columns = [pa.array(c) for c in (key[at], *identity[:, at], n[at], a[at].astype(np.int32), (a[at] + gram).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(body, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in slices(batches, length, piece):
            x, part, first, n, a, key, start = cut(parts, length, gram)
            raw = x.tobytes()
            ids, hs, offset = (np.array([p[k] for p in parts], np.int64) for k in range(3))
            for low in range(0, len(n), SEGMENTS):
                at = slice(low, low + SEGMENTS)
                identity = np.stack([ids[part[at]], hs[part[at]], start[at] + offset[part[at]]])
                yield from distinct(raw, identity, first[at], n[at], a[at], key[at])

    return rows.mapInArrow(run, ITEM)


def split(items: DataFrame, length: int) -> DataFrame:
    """The items with their strings dealt by longer shared bytes: to the left, or else to the right."""
    need = F.lit(length) - (F.col("b") - F.col("a"))
    left = F.floor((need + 1) / 2).cast("int")
    at = F.col("a") - left  # the last string that holds the bytes to the left
    sides = []
    for side, low, high, a, b in (
        (0, F.lit(0), F.least(at, F.col("n").cast("int") - 1), at, F.col("b")),
        (1, F.greatest(at + 1, F.lit(0)), F.col("n").cast("int") - 1, F.col("a"), F.col("b") + need - left + 1),
    ):
        key = F.xxhash64("key", F.lit(side), F.substring("body", a + 1, b - a))
        sides.append(F.when((low <= high) & (need > 0), F.struct(key.alias("key"), low.alias("low"), (high - low + 1).cast("long").alias("n"), a.alias("a"), b.alias("b"))))
    whole = F.when(need <= 0, F.struct("key", F.lit(0).alias("low"), "n", "a", "b"))
    each = items.withColumn("to", F.explode(F.array_compact(F.array(*sides, whole))))
    low, n = F.col("to.low"), F.col("to.n")
    body = F.substring("body", low + 1, (n + length - 1).cast("int"))
    return each.select("to.key", "id", "h", (F.col("start") + low).alias("start"), n.alias("n"), (F.col("to.a") - low).alias("a"), (F.col("to.b") - low).alias("b"), body.alias("body"))


def balanced(items: DataFrame, length: int, max_group: int) -> tuple[DataFrame, DataFrame]:
    """Items in groups of about ``max_group`` at most, and the ``REPEAT`` rows that were found on the way."""
    calm, found = None, items.where("body IS NULL").select("id", "h", "start", "n")
    items = items.where("body IS NOT NULL")
    while True:
        crowded = items.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > max_group).select("key")
        crowded = written(crowded)
        rest = items if crowded.isEmpty() else likely_in(items, crowded, "key", without=True)
        calm = rest if calm is None else calm.unionByName(rest)
        if rest is items:
            return calm, found
        many = likely_in(items, crowded, "key")
        place = F.struct("id", "h", "start")
        first = many.groupBy("body").agg(F.min(place).alias("p"), *[F.min_by(c, place).alias(c) for c in ("key", "n", "a", "b")])
        first = written(first.select("key", "p.*", "n", "a", "b", "body"))
        again = many.select("id", "h", "start", "n").join(first.select("id", "h", "start"), ["id", "h", "start"], "left_anti")
        found = found.unionByName(again)
        items = written(split(first, length))


def kinds(x: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than its successor; the last one counts as smaller."""
    end = np.flatnonzero(np.r_[x[1:] != x[:-1], True])  # of runs of one byte
    smaller = np.r_[x[end[:-1]] < x[end[:-1] + 1], True]
    return np.repeat(smaller, np.diff(np.r_[-1, end]))


def sorted_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from there on, eight at a time, as long as there are ties."""
    out = at[np.argsort(w[at], kind="stable")]
    if not len(out):
        return out
    group = np.cumsum(np.r_[True, w[out[1:]] != w[out[:-1]]])
    tied, w = np.arange(len(out)), np.r_[w, np.zeros(depth + 8, np.uint64)]
    for step in range(8, depth, 8):
        same = group[1:] == group[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        tied, group = tied[again], group[again]
        if not len(tied):
            break
        word = w[out[tied] + step]
        order = np.lexsort([word, group])
        out[tied] = out[tied][order]
        word = word[order]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
    return out


def two_stage(x: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of texts that end with a zero and hold none, as far as the first ``depth`` bytes."""
    smaller = kinds(x)
    direct = sorted_directly(np.flatnonzero(smaller & (x > 0)), w, depth)
    ends = np.searchsorted(x[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        bucket = []
        larger = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(larger):  # what stands before one of its own byte comes after it
            bucket.append(larger)
            larger = larger[larger > 0] - 1
            larger = larger[x[larger] == c]
        bucket.append(direct[ends[c] : ends[c + 1]] if c else np.flatnonzero(x == 0))
        bucket = np.concatenate(bucket)
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = x[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        start = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else []
        for b, part in zip(byte[start].tolist() if len(byte) else [], np.split(before, start[1:]) if len(byte) else [], strict=True):
            waiting[b].append(part)
    return np.concatenate(done)


def common_prefixes(order: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to ``most``, each suffix shares with the one before it in the order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    out[1:] = most
    alive = np.arange(1, len(order))
    w = np.r_[w, np.zeros(most + 8, np.uint64)]
    for step in range(0, most, 8):
        differ = w[order[alive] + step] ^ w[order[alive - 1] + step]
        ended = alive[differ != 0]
        differ = differ[differ != 0]
        out[ended] = np.minimum(most, step + 7 - sum((differ >> np.uint64(8 * k) != 0).astype(np.int64) for k in range(1, 8)))
        alive = np.setdiff1d(alive, ended, assume_unique=True) if len(ended) else alive
    return out


def repeated_strings(bodies: list[bytes], identity: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Ranges of strings that start earlier elsewhere: index of the body, first string, number of strings."""
    raw = b"\0".join(bodies) + b"\0"
    x = np.frombuffer(raw, np.uint8)
    size = np.array([len(b) for b in bodies])
    begin = np.cumsum(size + 1) - size - 1
    gap = begin + size
    x = x + np.uint8(1)  # no byte of UTF-8 is 255
    x[gap] = 0
    w = words_at(x)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    offset = np.arange(len(x)) - begin[owner]
    order = two_stage(x, w, length)
    order = order[(offset + length <= size[owner])[order]]
    new = common_prefixes(order, w, length) < length
    run = np.cumsum(new)
    several = ~(new & np.r_[new[1:], True])
    at, run = order[several], run[several]
    who = owner[at]
    place = np.stack([identity[0, who], identity[1, who], identity[2, who] + offset[at]])
    again, _ = repeats(run, place)
    at = np.sort(at[again])
    first = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])] if len(at) else np.zeros(0, bool)
    start = at[first]
    return owner[start], offset[start], np.diff(np.r_[np.flatnonzero(first), len(at)])


def compared(items: DataFrame, length: int) -> DataFrame:
    """The ``REPEAT`` rows that suffix arrays of the items' groups find."""
    names = [c.split(" ")[0] for c in REPEAT.split(", ")]

    def rows_of(identity: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, identity), pa.array(n.astype(np.int64))], names)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        identity = np.stack([table.column(c).to_numpy() for c in ("id", "h", "start")])
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        body = table.column("body").combine_chunks()
        again, lead = repeats(body.dictionary_encode().indices.to_numpy(), identity)
        if again.any():
            yield rows_of(identity[:, again], n[again])
        one = np.flatnonzero(lead == np.arange(len(lead)))  # one row for each text
        _, group, k = np.unique(key[one], return_inverse=True, return_counts=True)
        one = one[k[group] > 1]
        if len(one):
            who, low, m = repeated_strings(body.take(pa.array(one)).to_pylist(), identity[:, one], length)
            if len(who):
                found = identity[:, one[who]]
                found[2] += low
                yield rows_of(found, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if last:
                    yield from block(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            yield from block(pa.Table.from_batches(held))

    return items.repartition("key").sortWithinPartitions("key").mapInArrow(run, REPEAT)


def repeated_ranges(rows: DataFrame, *, length: int = 100, gram: int = 32, max_group: int = 4096, piece: int = SLICE) -> DataFrame:
    """``REPEAT`` rows for ``rows`` (id, h, text): ``n`` strings of ``length`` bytes from ``start`` on start earlier elsewhere, too."""
    shared = anchors(rows, length, gram, piece).where("k > 1").select("key")
    items = written(likely_in(dealt(rows, length, gram, piece), shared, "key", words=FILTER_WORDS))
    calm, found = balanced(items, length, max_group)
    return compared(calm, length).unionByName(found)


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, max_group: int = 4096, piece: int = SLICE) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``_kept`` (its bytes), ``_n_bytes``, ``_n_removed`` and ``_n_spans``."""
    key = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID))
    rows = docs.withColumns({"_id": key, "_h": F.xxhash64(F.col(f"`{text}`"))})
    spans = repeated_ranges(spread(rows.select(F.col("_id").alias("id"), F.col("_h").alias("h"), F.col(f"`{text}`").alias("text"))), length=length, gram=gram, max_group=max_group, piece=piece)
    by_document = spans.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda s: F.array(s["start"], s["n"])))
    by_document = written(by_document.select("_id", "_h", flat.alias("_s")))
    cleaned = likely_in(rows, by_document, "_h").join(by_document, ["_id", "_h"], "left")
    whole = likely_in(rows, by_document, "_h", without=True).withColumn("_s", F.lit(None).cast("array<long>"))
    return _removed(cleaned, docs.columns, text, length).unionByName(_removed(whole, docs.columns, text, length, any_spans=False))


def _removed(rows: DataFrame, columns: list[str], text: str, length: int, any_spans: bool = True) -> DataFrame:
    t = F.col(f"`{text}`")
    raw = F.coalesce(t, F.lit("")).cast("binary")
    size = F.octet_length(raw).cast("long")
    if any_spans:
        some = F.col("_s").isNotNull()
        rows = rows.withColumn("_r", F.when(some, _cleaner(length)(F.when(some, t), F.col("_s"))))
    else:
        rows = rows.withColumn("_r", F.lit(None).cast("struct<kept: binary, clean: string, spans: long>"))
    kept = F.coalesce(F.col("_r.kept"), raw)
    clean = F.when(F.col("_r.spans") > 0, F.col("_r.clean")).otherwise(t)
    return rows.select(
        *[clean.alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        kept.alias("_kept"), size.alias("_n_bytes"), (size - F.octet_length(kept)).alias("_n_removed"), F.coalesce(F.col("_r.spans"), F.lit(0)).cast("long").alias("_n_spans"),
    )


def _cleaner(length: int):
    def clean(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        kept, runs = [], []
        for text, span in zip(texts, spans, strict=True):
            raw = (text or "").encode()
            span = np.zeros(0, np.int64) if span is None else np.asarray(span, np.int64)
            low, high = span[::2], np.maximum.accumulate(span[::2] + span[1::2] + length - 1)
            first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]]) if len(low) else np.zeros(0, int)
            ends = high[np.r_[first[1:] - 1, len(low) - 1]] if len(low) else high
            edges = [0, *np.stack([low[first], ends], axis=1).ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            runs.append(len(first))
        return pd.DataFrame({"kept": kept, "clean": [k.decode("utf-8", "replace") for k in kept], "spans": runs})

    return F.pandas_udf(clean, "kept binary, clean string, spans long")
