"""Line dedup by a log-template tree of fixed depth.

1. Lines become token sequences; tokens with a digit are a variable field.  The tree's levels are the token count and the
   ``depth`` leading tokens; a line's leaf is their hash.  Per line only hashes of tokens travel on.
2. Equal lines are counted before the shuffle.  In leaves that occur in ``min_docs`` lines or more, lines that have the same
   tokens in ``similarity`` of the places or more belong to one template, and so do lines that such links connect; the template
   generalises the places that differ.  Two linked lines of n tokens differ in ``k = n - ceil(similarity n)`` places or fewer, so
   they agree in one of ``k + 1`` bands of places: lines are dealt by band, and no task holds a leaf whole.  The
   result depends neither on the order of the lines nor on how a leaf is split.
3. A template recurs if lines in ``min_docs`` different texts or more match it.  Recurring templates are dropped from all of
   them but one, the text with the smallest hash among those that hold it: whatever is dropped stays in one text, also of a
   family of near copies.  The texts alone decide; neither ids nor the order or partition of rows do.

Defined cases: a null text stays null, an empty one empty; lines without a token are kept; equal texts count as
one and keep or lose the same lines (document deduplication is what drops all but one of them); an empty table gives an empty result; clashing columns of the input are kept, the
operator's own names begin with ``_``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.bpe import pieces
from lexivec.llm.common import checkpointed, likely_in, spread, written
from lexivec.llm.simhash import components

FIELD = "<*>"


def line_table(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """``_row``, ``pos``, ``n`` tokens, ``leaf``, ``h`` of the masked line and ``tok``, the hashes of its tokens."""
    frame = docs.select("_row", F.col(f"`{text}`"))
    names = ["_row", "pos", "n", "leaf", "h", "tok"]
    field = zlib.crc32(FIELD.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = re.compile(rb"[0-9]").search
        for whole in batches:
            for batch in pieces(whole, 200):
                row, pos, n, leaf, h, tokens = [], [], [], [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for k, line in enumerate((t or "").encode().split(b"\n")):
                        words = line.split()  # space and \t to \r, as everywhere
                        if not words:
                            continue
                        ids = [field if digit(w) else zlib.crc32(w) for w in words] if digit(line) else list(map(zlib.crc32, words))
                        tokens += ids
                        row.append(i)
                        pos.append(k)
                        n.append(len(ids))
                        flat = np.array([len(ids), *ids], "<u4").tobytes()
                        leaf.append(xxhash.xxh3_64_intdigest(flat[: 4 * depth + 4]))
                        h.append(xxhash.xxh3_64_intdigest(flat))
                column = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.array(tokens, np.uint32).view(np.int32)))
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (leaf, h)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), *hashes, column], names)

    return frame.mapInArrow(run, "_row struct<a: long, b: long>, pos int, n int, leaf long, h long, tok array<int>")


def similar_rows(tokens: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span all links between rows of one length; with two values of ``side``, links between the sides."""
    comp, across = np.arange(len(tokens)), side.min() != side.max()
    found: list[tuple[int, int]] = []
    for i in range(len(tokens) - 1):
        rest = slice(i + 1, None)
        near = ((tokens[rest] == tokens[i]).sum(1) >= similarity * tokens.shape[1] - 1e-9) & (comp[rest] != comp[i])
        if across:
            near &= side[rest] != side[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if comp[j] != comp[i]:
                comp[comp == comp[j]] = comp[i]
                found.append((i, j))
    a, b = zip(*found, strict=True) if found else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def template_links(unique: DataFrame, *, similarity: float, depth: int, max_group: int) -> DataFrame:
    """Edges ``a``, ``b`` between hashes of lines of one leaf: spanning forests of all links within a band."""
    n = F.size("tok")
    bands = n - F.ceil(similarity * n - 1e-9) + 1
    edge = lambda j: F.lit(depth) + F.floor(j * (n - depth) / bands).cast("int")
    dealt = unique.where((bands > 1) & (n > depth)).select("leaf", "h", "tok", F.explode(F.sequence(F.lit(0).cast("long"), bands - 1)).alias("j"))
    start = edge(F.col("j"))
    dealt = dealt.select(F.xxhash64("leaf", "j", F.slice("tok", start + 1, edge(F.col("j") + 1) - start)).alias("key"), "h", "tok")
    shared = written(dealt.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))
    # At most rows / max_group bands are crowded.
    crowded = shared.where(F.col("k") > max_group).select("key", F.ceil(F.col("k") / max_group).cast("int").alias("parts"))
    dealt = likely_in(dealt, shared, "key").join(F.broadcast(crowded), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("node", F.pmod(F.xxhash64(F.lit(1), "h"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q"), "node", "h", "tok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # bands, each of max_group rows at most in a group
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        h, node = (table.column(c).to_numpy() for c in ("h", "node"))
        column = table.column("tok").combine_chunks()
        size = column.value_lengths().to_numpy()
        flat, begin = column.flatten().to_numpy(), np.cumsum(size) - size
        group = np.stack([size, *(table.column(c).to_numpy() for c in ("key", "p", "q"))])
        order = np.lexsort([h, *group])
        group = group[:, order]
        cut = np.r_[np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)]), len(order)]
        many, found = np.diff(cut), []
        for width in np.unique(group[0, cut[:-1][many == 2]]):  # most groups are pairs
            one = cut[:-1][(many == 2) & (group[0, cut[:-1]] == width)]
            i, j = order[one], order[one + 1]
            same = (flat[begin[i][:, None] + np.arange(width)] == flat[begin[j][:, None] + np.arange(width)]).sum(1)
            near = (same >= similarity * width - 1e-9) & ((group[2, one] == group[3, one]) | (node[i] != node[j]))
            found.append(np.stack([h[i[near]], h[j[near]]]))
        for x, y in zip(cut[:-1][many > 2], cut[1:][many > 2], strict=True):
            rows = order[x:y]
            a, b = similar_rows(flat[begin[rows][:, None] + np.arange(size[rows[0]])], node[rows], similarity)
            found.append(np.stack([h[rows[a]], h[rows[b]]]))
        if found:
            a, b = np.concatenate(found, axis=1)
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])

    return dealt.repartition("key", "p", "q").mapInArrow(run, "a long, b long")


def templates(lines: DataFrame, *, min_docs: int, similarity: float, depth: int, max_group: int) -> DataFrame:
    """``h`` of every line that belongs to a template of ``min_docs`` lines or more, and the template's ``tid``."""
    busy = written(lines.groupBy("leaf").agg(F.count("*").alias("k")).where(F.col("k") >= min_docs).select("leaf"))
    near = likely_in(lines, busy, "leaf")
    unique = checkpointed(near.groupBy("leaf", "h").agg(F.count("*").alias("lines"), F.first("tok").alias("tok")).join(busy, "leaf", "left_semi"))
    links = components(template_links(unique, similarity=similarity, depth=depth, max_group=max_group))
    named = unique.select("h", "lines").join(links.withColumnRenamed("v", "h"), "h", "left").select("h", "lines", F.coalesce("root", "h").alias("tid"))
    named = checkpointed(named)
    often = written(named.groupBy("tid").agg(F.sum("lines").alias("k")).where(F.col("k") >= min_docs).select("tid"))
    return named.join(often, "tid", "left_semi").select("h", "tid")


def recurring_lines(lines: DataFrame, *, min_docs: int, similarity: float, depth: int, max_group: int) -> DataFrame:
    """``_row`` and ``_drop``, the places of its lines to drop."""
    named = written(templates(lines, min_docs=min_docs, similarity=similarity, depth=depth, max_group=max_group).dropDuplicates(["h"]))
    hits = likely_in(lines.select("_row", "pos", "h"), named, "h").join(named, "h").select("_row", "pos", "tid")
    hits = checkpointed(hits)
    texts = hits.select("tid", "_row").distinct().groupBy("tid").agg(F.count("*").alias("k"), F.min("_row").alias("_witness"))
    recurring = written(texts.where(F.col("k") >= min_docs).select("tid", "_witness"))
    return hits.join(recurring, "tid").where(F.col("_row") != F.col("_witness")).groupBy("_row").agg(F.sort_array(F.collect_set("pos")).alias("_drop"))


def drop_recurring_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 3, similarity: float = 0.8, depth: int = 3, max_group: int = 512) -> DataFrame:
    """``docs`` with ``text`` cleaned, ``_n_lines`` and ``_n_dropped``."""
    t = F.col(f"`{text}`")
    rows = docs.withColumn("_row", F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t, F.lit(2)).alias("b")))
    lines = written(line_table(spread(rows.select("_row", t)), text, depth))
    drops = recurring_lines(lines, min_docs=min_docs, similarity=similarity, depth=depth, max_group=max_group)
    rows = rows.join(drops, "_row", "left")
    parts = F.split(t, "\n")
    less = _kept_lines(F.when(F.col("_drop").isNotNull(), t), F.col("_drop"))
    return rows.select(
        *[F.when(F.col("_drop").isNull(), t).otherwise(less).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(t.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("_n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("_n_dropped"),
    )


def _kept_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the given places."""

    def kept(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, drop in zip(texts, places, strict=True):
            drop = set() if t is None else set(drop.tolist())
            out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(kept, "string")(text, gone)
