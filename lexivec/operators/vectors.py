"""Vector tables: exact search, id maps, pooling, contrastive scores, losses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as V
from lexivec.operators.relational import dense_ids

QUERY_BLOCK = 2048


def exact_topk(base: DataFrame, queries: DataFrame, k: int, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the k largest cosines for each query, its own row excepted.

    Queries are dealt into blocks of about ``QUERY_BLOCK`` rows, each of which meets every row of the base once, in
    matrix products inside Arrow batches; a task returns k rows per query it met, and one aggregation
    merges them.  Vectors of norm zero take no part."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asks = queries.select(F.col(id_column).alias("query_id"), V.normalized(F.col(vector)).alias("q"), F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias("block"))
    asks = asks.where(V.norm(F.col("q")) > 0).groupBy("block").agg(*_columns("query_id", "q"))
    rows = base.select(F.col(id_column).alias("id"), V.normalized(F.col(vector)).alias("v")).where(V.norm(F.col("v")) > 0)
    chunk = F.floor(F.monotonically_increasing_id() / F.lit(QUERY_BLOCK))
    packed = rows.withColumn("chunk", chunk).groupBy("chunk").agg(*_columns("id", "v"))
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asks, "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, names, q = (batch.column(c)[i].values for c in ("id_all", "v_all", "query_id_all", "q_all"))
                ids, names = ids.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False)
                s = q.to_numpy(zero_copy_only=False).reshape(len(names), -1) @ v.to_numpy(zero_copy_only=False).reshape(len(ids), -1).T
                s[names[:, None] == ids[None]] = -np.inf
                s = np.round(s, 12)
                order = np.lexsort([np.broadcast_to(ids, s.shape), -s])[:, :k]
                query, near, best = np.repeat(names, order.shape[1]), ids[order].ravel(), np.take_along_axis(s, order, 1).ravel()
                real = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (query, near, best)], ["query_id", "vec_id", "score"])

    found = met.select("id_all", "v_all", "query_id_all", "q_all").mapInArrow(score, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def _columns(name: str, vector: str) -> list[Column]:
    """The ids and the flat numbers of a block's vectors, both in the order of ids, as plain arrays that Arrow hands to numpy as they are."""
    block = F.sort_array(F.collect_list(F.struct(name, vector)))
    return [F.transform(block, lambda x: x[name]).alias(f"{name}_all"), F.flatten(F.transform(block, lambda x: x[vector])).alias(f"{vector}_all")]


def id_map(rows: DataFrame, id_column: str, order: Sequence[str], duplicates: str = "first") -> DataFrame:
    """``id``, ``vid``.  ``first``: an id gets the next number where it first appears.  ``last``: all rows are
    numbered, and an id has its last row's number."""
    if duplicates == "first":
        first = rows.groupBy(F.col(id_column).alias("id")).agg(F.min(F.struct(*order)).alias("at"))
        return dense_ids(first, ["at"], "vid").select("id", "vid")
    return all_vids(rows, id_column, order).groupBy("id").agg(F.max("vid").alias("vid"))


def all_vids(rows: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """``vid``, ``id`` of every row: the inverse map, which keeps repeats."""
    return dense_ids(rows.select(F.col(id_column).alias("id"), *[o for o in order if o != id_column]), order, "vid").select("vid", "id")


def duplicate_map(rows: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """``id``, ``vid`` of ids that repeat: how many different ids there were at its last repeat."""
    at = F.struct(*order)
    known = rows.groupBy(F.col(id_column).alias("id")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    marks = known.select(F.col("first").alias("at"), F.lit(1).alias("new"), F.lit(None).cast(known.schema["id"].dataType).alias("id"))
    marks = marks.unionByName(known.where("n > 1").select(F.col("last").alias("at"), F.lit(0).alias("new"), "id"))
    # A running count needs the order of first appearances only, one row per different id.
    numbered = dense_ids(marks.where("new = 1").select("at"), ["at"], "k")
    repeats = marks.where("new = 0").select("id", "at")
    merged = numbered.select("at", F.col("k").alias("k"), F.lit(None).cast(known.schema["id"].dataType).alias("id"))
    merged = merged.unionByName(repeats.select("at", F.lit(None).cast("long").alias("k"), "id"))
    return running_last(merged, "at", "k").where("id IS NOT NULL").select("id", (F.col("k") + 1).alias("vid"))


def running_last(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``value`` filled forward along ``order``: within ranges by a window, across ranges by the ranges' last values."""
    from lexivec.sources.storage import checkpointed

    dealt = checkpointed(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    ends = dealt.groupBy("_p").agg(F.max(value).alias("_end"))  # values grow with the order
    carry = F.max("_end").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_p", carry.alias("_carry"))  # a row per partition
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_p").orderBy(order))
    return dealt.join(F.broadcast(ends), "_p").withColumn(value, F.coalesce(inside, "_carry")).drop("_p", "_carry")


def sequences(rows: DataFrame, size: int, id_column: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """Runs of ``size`` ids as one sequence: ``seq`` and ``steps``, ordered structs of ``pos``, ``v`` and ``keep``."""
    pos = F.pmod(F.col(id_column), F.lit(size)).cast("int")
    step = F.struct(pos.alias("pos"), F.col(vector).cast("array<double>").alias("v"), *keep)
    return rows.groupBy(F.floor(F.col(id_column) / size).alias("seq")).agg(F.sort_array(F.collect_list(step)).alias("steps"))


def pooled_mean(steps: Column, mask, width: int, denominator: str = "mask") -> Column:
    return V.masked_mean(F.transform(steps, lambda s: s["v"]), F.transform(steps, mask), width, denominator)


def explode_dims(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.posexplode(vector).alias("dim", "x"))


def contrastive(rows: DataFrame, batch: str, query: str, context: str, q: str, c: str) -> DataFrame:
    """Log probabilities of every context of a batch for its queries (softmax of inner products).
    A batch is bounded by its definition."""
    asks, answers = rows.select(batch, query, q), rows.select(batch, context, c)
    scored = asks.join(answers, batch).select(batch, query, context, V.dot(F.col(q), F.col(c)).alias("s"))
    by = Window.partitionBy(batch, query)
    top = F.max("s").over(by)
    return scored.withColumn("logp", F.col("s") - top - F.log(F.sum(F.exp(F.col("s") - top)).over(by)))


def hard_pairs(rows: DataFrame, batch: str, item: str, label: str, unit: str, epsilon: float = 0.1) -> DataFrame:
    """``batch``, ``anchor``, ``other``, ``same``: the pairs worth learning from.

    A positive pair counts if it is less similar than the anchor's hardest negative plus ``epsilon``, a negative one if it is more similar than the
    hardest positive minus ``epsilon``: two extremes an anchor take the place of all its triples.  Anchors without positives or without negatives
    have none, nor have rows with a null label.  A batch is bounded by its definition."""
    side = lambda s: rows.where(F.col(label).isNotNull()).select(F.col(batch).alias("batch"), *[F.col(c).alias(n + s) for c, n in ((item, "item"), (label, "label"), (unit, "v"))])
    pairs = side("").join(side("_o"), "batch").where("item <> item_o")
    pairs = pairs.select("batch", F.col("item").alias("anchor"), F.col("item_o").alias("other"), (F.col("label") == F.col("label_o")).alias("same"), F.round(V.dot(F.col("v"), F.col("v_o")), 9).alias("s"))
    by = Window.partitionBy("batch", "anchor")
    nearest_other = F.max(F.when(~F.col("same"), F.col("s"))).over(by)
    farthest_same = F.min(F.when(F.col("same"), F.col("s"))).over(by)
    hard = F.when(F.col("same"), F.col("s") - epsilon < nearest_other).otherwise(F.col("s") + epsilon > farthest_same)
    return pairs.withColumn("hard", hard).where("hard").select("batch", "anchor", "other", "same")
