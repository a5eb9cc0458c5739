"""Best-fit packing in a tree: partitions pack locally, underfull bins travel up as items.

1. Every task tokenises its documents, appends the end id, cuts only what is longer
   than a sequence (the first piece takes the remainder), and packs its pieces by
   best fit, longest first.
2. Bins filled to within ``slack`` tokens are final.  The others are items of
   a next round, in which ``fan_in`` neighbouring partitions are packed as one; so on until one group is left.
3. A group holds about ``max_items`` pieces at most.  Where one group can't hold all that is left, the bins are dealt
   anew among bounded groups, round by round, until a round saves less than ``least_gain`` of them.  Nothing is dropped.

Only piece records (no texts, no ids) travel between rounds, and each round is
checkpointed in the shared folder.

Defined cases: a null text is the empty text (one piece of the end id); repeated rows are packed each by itself;
ties go to the bin opened first; an empty table gives no rows; other columns don't travel along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.bpe import PATTERN, Vocabulary, pieces, split_words, vocabulary_at
from lexivec.llm.common import checkpointed

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenizer(vocab_path: str) -> tiktoken.Encoding:
    """The vocabulary file in tiktoken's form: ids are ranks, added tokens are recognised in texts."""
    vocab = Vocabulary(vocab_path)
    ranks = {t: i for i, t in enumerate(vocab.tokens) if t and i not in vocab.added.values()}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocab.added)


def encoded(coder: tiktoken.Encoding, vocab_path: str, text: str) -> np.ndarray:
    """The ids of a text.  The library's splitter gives up on very long runs of white space; our own splitter and merges take those texts."""
    try:
        ids = coder.encode(text, allowed_special="all")
    except ValueError:
        vocab = vocabulary_at(vocab_path)
        words = next(split_words([text], vocab.added))
        new = list(set(words) - vocab.added.keys())
        known = dict(zip(new, vocab.merge([w.encode() for w in new]), strict=True)) | {k: np.int32(v).tobytes() for k, v in vocab.added.items()}
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
    return np.array(ids, "<u4")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go, longest first, to the fullest bin that holds them."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: dict[int, deque[int]] = {}  # bins by free space; the list of free spaces stays sorted
    spaces: list[int] = []
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = room[space].popleft()
            if not room[space]:
                del room[space], spaces[at]
        else:
            space, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - space
        if left := space - size:
            if left not in room:
                room[left] = deque()
                insort(spaces, left)
            room[left].append(b)
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pack(
    docs: DataFrame,
    vocab_path: str,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    slack: int = 16,
    fan_in: int = 8,
    max_items: int = 1_000_000,
    least_gain: float = 0.001,
) -> DataFrame:
    """One row per piece (``PIECE``): where it was cut and where it lies."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokenizer(vocab_path), TaskContext.get().partitionId()
        rows: list[tuple] = []
        for whole in batches:
            for batch in pieces(whole):
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(encoded(coder, vocab_path, body or ""), np.uint32(end_id)).astype("<u4")
                    rows += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), capacity))]
        if rows:
            df = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            df["doc_id"] = df["doc_id"].astype("Int64")
            bins, df["offset"] = best_fit(df["length"].to_numpy(), capacity)
            df["sequence_id"] = (np.int64(part) << 32) + bins
            df["fill"] = df.groupby("sequence_id")["length"].transform("sum")
            df["place"] = part
            yield from pa.Table.from_pandas(df[names], schema=arrow, preserve_index=False).to_batches(max_chunksize=50_000)

    names = [x.split(" ")[0] for x in PIECE.split(", ")] + ["fill", "place"]
    arrow = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in names])
    frame = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    groups = frame.rdd.getNumPartitions()
    packed = checkpointed(frame.mapInArrow(local, f"{PIECE}, fill long, place long"))
    final = []
    full = F.col("fill") >= capacity - slack
    before, deal = None, 0
    while groups > 1:
        rest = packed.where(~full)
        left = rest.agg(F.count("*").alias("items"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        fewer = max(-(-groups // fan_in), -(-left.items // max_items))
        place = F.floor(F.col("place") * fewer / groups)
        if fewer >= groups:  # groups are full: let other bins meet
            if before is not None and left.bins >= before * (1 - least_gain):
                break
            fewer, before, deal = min(fewer, groups), left.bins, deal + 1
            place = F.pmod(F.xxhash64(F.lit(deal), "sequence_id"), F.lit(fewer))
        final.append(packed.where(full))
        rest = rest.withColumn("place", place.cast("long"))
        packed = checkpointed(rest.groupBy("place").applyInArrow(lambda g: repack(g, capacity), f"{PIECE}, fill long, place long"))
        groups = fewer
    for part in final:
        packed = packed.unionByName(part)
    return packed.drop("fill", "place")


def repack(group: pa.Table, capacity: int) -> pa.Table:
    """Best fit over whole bins: a bin moves as one item, into the bin of the largest it meets."""
    group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    column = {n: group.column(n).to_numpy() for n in ("sequence_id", "offset", "length", "fill")}
    old, head = np.unique(column["sequence_id"], return_index=True)
    bins, offsets = best_fit(column["fill"][head], capacity)
    first = np.zeros(bins.max() + 1, np.int64)
    first[bins[offsets == 0]] = old[offsets == 0]
    at = np.searchsorted(old, column["sequence_id"])
    column["offset"] = column["offset"] + offsets[at]
    column["sequence_id"] = first[bins[at]]
    column["fill"] = np.bincount(bins[at], weights=column["length"]).astype(np.int64)[bins[at]]
    for name in ("sequence_id", "offset", "fill"):
        group = group.set_column(group.column_names.index(name), name, pa.array(column[name], pa.int64()))
    return group
