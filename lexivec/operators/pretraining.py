"""Sentence runs with a continuation, and shards filled by the room that is left."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.operators.corpus import hash_number, running_sum, truncated_pair
from lexivec.operators.intervals import lookup
from lexivec.operators.relational import dense_ids
from lexivec.sources.storage import checkpointed

FIRST, LAST = "[CLS]", "[SEP]"


def run_breaks(sizes: np.ndarray, targets: np.ndarray, splits: np.ndarray, coins: np.ndarray) -> list[list[int]]:
    """``[start, split, stop, is_random]`` of each run.  All sentences get the place where a run from there would
    stop (one search in the sums of their sizes) and its successor; then the successors are followed from the first."""
    m = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    here = np.arange(m)
    stops = np.minimum(np.searchsorted(upto, upto[:-1] + targets), m)
    split = np.where(stops - here > 1, 1 + splits % np.maximum(stops - here - 1, 1), 1)
    random = (stops - here == 1) | (coins != 0)
    after = np.where(random, here + split, stops)
    rows, i = np.stack([here, split, stops, random.astype(np.int64)], 1), 0
    taken = []
    while i < m:
        taken.append(i)
        i = after[i]
    return rows[taken].tolist()


def sentence_runs(docs: DataFrame, doc: str, sentences: str, max_tokens: int, short_share: float = 0.1) -> DataFrame:
    """``doc``, ``run``, ``start``, ``stop``, ``is_random``, ``first``, ``second`` of documents that are lists of token lists.

    A run takes sentences until its target (one in ten is short) or the document's end and is split at a drawn sentence.  Its
    second part is what follows, or, by a coin and always where nothing follows, the last one or two sentences of another
    document; then the sentences after the split go into the next run.  All draws are hashes of document and place.  Both
    parts together are cut to ``max_tokens`` less three.  Null and empty documents have no runs; without a
    second document a run of one sentence has no second part and is left out."""
    full = max_tokens - 3
    given = docs.select(doc, F.filter(sentences, lambda s: F.size(s) > 0).alias("_s")).where(F.size("_s") > 0)
    tails = given.select(F.col(doc).alias("_other"), F.element_at("_s", -1).alias("_one"), F.flatten(F.slice("_s", F.greatest(F.size("_s") - 1, F.lit(1)), 2)).alias("_two"))
    tails = checkpointed(dense_ids(tails, ["_other"], "_i"))
    total = tails.count()

    @F.pandas_udf("array<array<int>>")
    def breaks(sizes: pd.Series, targets: pd.Series, splits: pd.Series, coins: pd.Series) -> pd.Series:
        return pd.Series([run_breaks(*row) for row in zip(sizes, targets, splits, coins, strict=True)], dtype=object)

    def drawn(name: str):
        return lambda s, i: hash_number(F.col(doc), i, name)

    target = lambda h: F.when(h % 1000 < int(1000 * short_share), h % (full - 1) + 2).otherwise(full)
    coins = F.transform("_s", lambda s, i: (hash_number(F.col(doc), i, "coin") % 2 == 0).cast("long") if total > 1 else F.lit(0).cast("long"))
    each = given.select(doc, "_s", breaks(F.transform("_s", lambda s: F.size(s)), F.transform(F.transform("_s", drawn("target")), target), F.transform("_s", drawn("split")), coins).alias("_runs"))

    def part(r: Column) -> Column:
        tokens = F.col("_s")
        return F.struct(
            r[0].alias("start"), r[2].alias("stop"), r[3].alias("is_random"), F.flatten(F.slice(tokens, r[0] + 1, r[1])).alias("first"), F.flatten(F.slice(tokens, r[0] + r[1] + 1, r[2] - r[0] - r[1])).alias("second")
        )

    runs = each.select(doc, F.posexplode(F.transform("_runs", part)).alias("run", "_x")).select(doc, "run", "_x.*")
    if total > 1:
        runs = _continued(runs, doc, tails, total)
    runs = runs.where(F.size("second") > 0)
    first, second = truncated_pair(F.col("first"), F.col("second"), full, hash_number(F.col(doc), F.col("start"), "front") % 2 == 0)
    return runs.select(doc, "run", "start", "stop", "is_random", first.alias("first"), second.alias("second"))


def _continued(runs: DataFrame, doc: str, tails: DataFrame, total: int) -> DataFrame:
    """Runs marked random get the tail of a drawn document, or of the one after it where their own was drawn."""
    after = tails.select(F.pmod(F.col("_i") - 1, F.lit(total)).alias("_i"), F.col("_one").alias("_one2"), F.col("_two").alias("_two2"))
    pairs = tails.join(after, "_i")
    h = hash_number(F.col(doc), F.col("start"), "doc")
    # rows that draw nothing get keys of their own below zero, so that they don't share one
    keyed = runs.withColumn("_i", F.when(F.col("is_random") == 1, h % total).otherwise(-1 - h))
    two = hash_number(F.col(doc), F.col("start"), "tail") % 2 == 0
    own = F.col("_other") == F.col(doc)
    tail = F.when(own & two, F.col("_two2")).when(own, F.col("_one2")).when(two, F.col("_two")).otherwise(F.col("_one"))
    joined = keyed.join(pairs, "_i", "left")
    return joined.withColumn("second", F.when(F.col("is_random") == 1, tail).otherwise(F.col("second"))).select(*runs.columns)


def with_segments(runs: DataFrame) -> DataFrame:
    """``tokens`` with their marks, and ``segments``: 0 up to the first part's end mark, 1 after it."""
    mark = lambda t: F.array(F.lit(t))
    tokens = F.concat(mark(FIRST), F.col("first"), mark(LAST), F.col("second"), mark(LAST))
    segments = F.concat(F.array_repeat(F.lit(0), F.size("first") + 2), F.array_repeat(F.lit(1), F.size("second") + 1))
    return runs.withColumn("tokens", tokens).withColumn("segments", segments)


def filled_shards(docs: DataFrame, doc: str, size: Column, shards: int, test_share: float = 0.1, least: int = 2, fine: int = 100) -> DataFrame:
    """``doc``, ``size``, ``shard``, ``split``: documents, largest first, go to the shard with the most room.

    Those over a ``fine``-th of a shard (at most ``fine`` a shard) are placed one by one, from a histogram of their
    sizes; of the others none matters alone, so they fill, in order, the room below the common level: each shard takes an interval of
    the running sum of sizes.  No shard ends more than a ``fine``-th above the level.  Documents under ``least`` are left out."""
    rows = docs.select(doc, size.cast("long").alias("size")).where(F.col("size") >= least)
    ranked = dense_ids(rows, [-F.col("size"), F.col(doc)], "_r")
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("size") * (fine * shards) > total
    counts = ranked.where(large).groupBy("size").count().orderBy(F.desc("size")).collect()  # fine * shards rows at most
    heap = [(0, k) for k in range(shards)]
    chosen = []
    for bulk, n in counts:
        for _ in range(n):
            fill, k = heap[0]
            chosen.append(k)
            heapq.heapreplace(heap, (fill + bulk, k))
    fills = np.array([fill for fill, _ in sorted(heap, key=lambda x: x[1])], np.int64)
    rest = total - int(fills.sum())
    level = min(-(-(rest + int(s)) // (j + 1)) for j, s in enumerate(np.cumsum(np.sort(fills))))
    room = np.maximum(level - fills, 0)
    high = np.cumsum(room) - 1
    spark = docs.sparkSession
    places = spark.createDataFrame([(r, k) for r, k in enumerate(chosen)], "_r long, shard int")
    intervals = spark.createDataFrame([(int(h - n + 1), int(h), k) for k, (h, n) in enumerate(zip(high, room, strict=True)) if n], "low long, high long, shard int")
    small = running_sum(ranked.where(~large), ["_r"], F.col("size"), "_upto").withColumn("_before", F.col("_upto") - F.col("size"))
    small = lookup(small, "_before", intervals, "low", "high", "shard")
    tests = -(-int(shards * test_share * 1000) // 1000)
    both = ranked.where(large).join(places, "_r").select(doc, "size", "shard").unionByName(small.select(doc, "size", "shard"))
    return both.withColumn("split", F.when(F.col("shard") < tests, "test").otherwise("train"))
