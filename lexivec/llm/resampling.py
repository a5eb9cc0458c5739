"""Importance resampling towards a target distribution, by word tries.

1. Every task walks its texts through a trie of words: a node is a feature (the words on its path, joined by one space)
   and holds its count and the CRC-32 state of its bytes, from which a child's state goes on.  A trie of ``max_nodes``
   nodes is folded into bucket totals (CRC modulo ``buckets``) and started anew, so memory doesn't grow with the input.
2. Spark sums the bucket totals of the corpus and of the target; ``buckets`` numbers a side reach the driver, which takes
   the gains ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``.
3. The texts are walked again through tries whose nodes hold the gain of their bucket.  A document's weight is the floored
   mean of the gains met; its score adds Gumbel noise that comes from a hash of its id.
4. Of the documents with ``min_words`` words or more, ``floor(percent N / 100)`` of the highest scores are drawn, ranked by ranges
   of the score, not in one task.

Defined cases: a null or empty text has no features, weight 0 and is never drawn (``min_words`` of 1 or more); a null id
counts as the empty string in the noise and comes first in ties; rows that repeat are scored and drawn each by itself, one after the other; an empty
corpus gives no rows; with an empty target the gains follow the corpus alone; other columns don't travel along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.bpe import pieces
from lexivec.llm.common import written
from lexivec.operators.relational import dense_ids

# Digits, letters and every byte of a character beyond ASCII make words; A-Z are lower-cased; all else parts words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
VALUE, STATE, CHILDREN = range(3)  # of a node


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Trie:
    """Nodes by words.  ``value`` gives a new node's value from the CRC-32 of its path."""

    def __init__(self, value):
        self.value, self.root, self.nodes = value, {}, 0

    def child(self, nodes: dict, word: bytes, parent: list | None) -> list:
        state = zlib.crc32(word if parent is None else b" " + word, 0 if parent is None else parent[STATE])
        node = nodes[word] = [self.value(state), state, None]
        self.nodes += 1
        return node

    def runs(self, words: list[bytes], start: int, stop: int, longest: int) -> Iterator[list]:
        """The node of every run of up to ``longest`` consecutive words that starts in a section of a text."""
        root = self.root
        for i in range(start, stop):
            node = root.get(words[i])
            if node is None:
                node = self.child(root, words[i], None)
            yield node
            for word in words[i + 1 : i + longest]:
                nodes = node[CHILDREN]
                if nodes is None:
                    nodes = node[CHILDREN] = {}
                parent, node = node, nodes.get(word)
                if node is None:
                    node = self.child(nodes, word, parent)
                yield node

    def fold(self, totals: np.ndarray) -> None:
        """Add the counts of all nodes to the totals of their buckets, and start anew."""
        level = [self.root]
        while level:
            nodes = [n for d in level for n in d.values()]
            if nodes:
                state = np.fromiter((n[STATE] for n in nodes), np.int64, len(nodes))
                np.add.at(totals, state % len(totals), np.fromiter((n[VALUE] for n in nodes), np.int64, len(nodes)))
            level = [n[CHILDREN] for n in nodes if n[CHILDREN]]
        self.root, self.nodes = {}, 0


def bucket_totals(docs: DataFrame, *, text: str = "text", longest: int = 1, buckets: int = 10_000, max_nodes: int = 200_000) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts that fall into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie(lambda state: 0)
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                for start in range(0, len(words), max_nodes):  # sections bound what one text adds
                    for node in trie.runs(words, start, min(start + max_nodes, len(words)), longest):
                        node[VALUE] += 1
                    if trie.nodes >= max_nodes:
                        trie.fold(totals)
        trie.fold(totals)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: np.ndarray, target: np.ndarray) -> list[int]:
    """The gain of each bucket, in thousandths."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)]


def weighted(docs: DataFrame, gains: list[int], *, id_column: str = "doc_id", text: str = "text", longest: int = 1, max_nodes: int = 200_000) -> DataFrame:
    """``id_column``, ``n_words``, ``n_features`` and ``weight`` of every row."""
    frame = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([frame.schema.fields[0], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(lambda state: gains[state % len(gains)])
        for whole in batches:
            for batch in pieces(whole):
                rows = []
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    total = features = 0
                    for start in range(0, len(words), max_nodes):
                        for node in trie.runs(words, start, min(start + max_nodes, len(words)), longest):
                            total += node[VALUE]
                            features += 1
                        if trie.nodes >= max_nodes:
                            trie.root, trie.nodes = {}, 0
                    rows.append((len(words), features, total // features if features else 0))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return frame.mapInArrow(score, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    min_words: int = 20,
    percent: int = 10,
    seed: str = "2024",
    max_nodes: int = 200_000,
) -> DataFrame:
    """``id_column``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null where not drawn) for every row."""
    sides = []
    for df, column in ((docs, text), (target, target_text)):
        sides.append(np.zeros(buckets, np.int64))
        for r in bucket_totals(df, text=column, longest=longest, buckets=buckets, max_nodes=max_nodes).collect():  # buckets rows at most
            sides[-1][r.bucket] = r.n
    rows = weighted(docs, gains_of(*sides), id_column=id_column, text=text, longest=longest, max_nodes=max_nodes)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = written(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))))
    able = F.col("n_words") >= min_words
    drawn = rows.where(able).count() * percent // 100
    ranked = dense_ids(rows.where(able), [-F.col("score"), F.col(f"`{id_column}`")], "rank", 1) if drawn else rows.where(able).withColumn("rank", F.lit(1))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
