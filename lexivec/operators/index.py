"""A stored exact index: unit vectors dealt to balls, searched ball by ball until no other ball can matter.

Building: centres are taken from a bounded sample, each as far as can be from those before; every vector goes to its nearest one, and a ball is its centre and the largest angle
to it.  Vectors lie on disk by ball (a folder each, cut into chunks of bounded size), with their ids and consecutive numbers.

Searching: the cosine of a query with any vector of a ball is at most ``cos(max(0, angle to the centre - radius))``.  Each query visits balls in the order of
that bound, twice as many each round, and stops when its k-th score beats the next bound (and what rounding may add to it): the result is that of
comparing all rows.  Only the table of balls (``MOST_BALLS`` rows at most) reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions import vectors as V
from lexivec.functions.text import stable_hash
from lexivec.operators.relational import dense_ids
from lexivec.sources.storage import checkpointed

MOST_BALLS = 4096
SAMPLE = 8  # rows of the sample for each ball
CHUNK = 4096  # vectors of a ball that are met at once
ASKS = 2048  # queries that meet them at once


@dataclass(frozen=True)
class Index:
    vectors: DataFrame  # ball, chunk, vid, id, v
    balls: DataFrame  # ball, n, chunks, radius, centre

    def ids(self) -> DataFrame:
        """``vid``, ``id``: numbers in the order of ids."""
        return self.vectors.select("vid", "id")


def units(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id`` and unit vector ``v``; null, zero and non-finite vectors and null ids take no part."""
    size = V.norm(F.col(f"`{vector}`"))
    fine = F.col(f"`{id_column}`").isNotNull() & (size > 0) & (size < float("inf"))
    return rows.where(fine).select(F.col(f"`{id_column}`").alias("id"), V.normalized(F.col(f"`{vector}`")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def spread_out(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one farthest from those before it, so that every cluster of the sample has a centre."""
    picked, near = [0], x @ x[0]
    while len(picked) < most and near.min() < 1 - 1e-12:
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def build(rows: DataFrame, path: str, *, id_column: str = "vec_id", vector: str = "embedding", balls: int | None = None, seed: int = 5) -> Index:
    """Write the index of ``rows`` to a folder.  ``balls`` is the square root of the number of rows unless given, ``MOST_BALLS`` at most.
    All vectors must be of one width; of rows that repeat an id each is in the index."""
    spark = rows.sparkSession
    known = checkpointed(dense_ids(units(rows, id_column, vector), ["id", "v"], "vid").select("vid", "id", "v"))
    n = known.count()
    balls = min(MOST_BALLS, balls or math.isqrt(n) + 1)
    if not n:
        spark.createDataFrame([], "ball int, n long, chunks int, radius double, centre array<double>").write.parquet(f"{path}/balls")
        return stored(spark, path)
    sample = known.orderBy(stable_hash(F.col("vid"), seed=seed), "vid").limit(SAMPLE * balls).select("v").collect()  # SAMPLE * MOST_BALLS rows at most
    c = spread_out(np.array([r.v for r in sample], float), balls)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                s = matrix(part.column(2), c.shape[1]) @ c.T
                at = s.argmax(1)
                angle = np.arccos(np.clip(s[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(angle)], ["vid", "id", "v", "ball", "angle"])

    kind = known.schema["id"].dataType.simpleString()
    dealt = checkpointed(known.mapInArrow(nearest, f"vid long, id {kind}, v array<double>, ball int, angle double"))
    table = dealt.groupBy("ball").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.max("angle").alias("radius"))
    centre = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "ball int, centre array<double>")
    table.join(F.broadcast(centre), "ball").write.parquet(f"{path}/balls")  # MOST_BALLS rows
    chunk = F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int").alias("chunk")
    dealt.join(F.broadcast(table.select("ball", "chunks")), "ball").select("ball", chunk, "vid", "id", "v").repartition("ball", "chunk").write.partitionBy("ball").parquet(f"{path}/vectors")
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> Index:
    balls = spark.read.parquet(f"{path}/balls")
    if balls.isEmpty():
        return Index(spark.createDataFrame([], "ball int, chunk int, vid long, id long, v array<double>"), balls)
    return Index(spark.read.parquet(f"{path}/vectors").select("ball", "chunk", "vid", "id", "v"), balls)


def search(index: Index, queries: DataFrame, k: int, *, id_column: str = "vec_id", vector: str = "embedding", first: int = 2, digits: int = 12) -> tuple[DataFrame, DataFrame]:
    """``query_id``, ``vec_id``, ``vid``, ``score``: the k largest cosines, rounded to ``digits``, of each query, its own id excepted (ties
    of rounded scores: the smaller id); and ``query_id``, ``visited``, how many rows of the index were compared with it."""
    held = sorted(index.balls.collect(), key=lambda r: r.ball)  # MOST_BALLS rows at most
    asked = units(queries, id_column, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    kind = asked.schema["query_id"].dataType.simpleString()
    state = checkpointed(asked.withColumn("kth", F.lit(-2.0)))
    found = state.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0).cast("long").alias("vid"), F.lit(0.0).alias("score")).where("false")
    seen = state.select("query_id", F.lit(0).cast("long").alias("visited"))
    if not held:
        return found, seen
    c, radius = np.array([r.centre for r in held]), np.array([r.radius for r in held])
    unit = 10.0**digits
    slack = 1e-7 + 0.5 / unit  # angles near 0 are known to some 2e-8, and scores are rounded up by half a digit at most
    names, sizes, chunks = (np.array([r[x] for r in held]) for x in ("ball", "n", "chunks"))

    def asks_of(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    angle = np.arccos(np.clip(matrix(part.column(1), c.shape[1]) @ c.T, -1, 1))
                    bound = np.cos(np.maximum(angle - radius, 0)) + slack
                    order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    kth = part.column(2).to_numpy()
                    q, o = np.nonzero(np.take_along_axis(bound, order, 1) >= kth[:, None])
                    b = order[q, o]
                    take = pa.array(q)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *(pa.array(x[b].astype(t)) for x, t in ((names, np.int32), (sizes, np.int64), (chunks, np.int32)))], ["query_id", "q", "ball", "n", "chunks"])

        return run

    def met(key: tuple, rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.table({"query_id": asks.column("query_id").slice(0, 0), "vec_id": asks.column("query_id").slice(0, 0), "vid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, vid, name = (t.column(x).to_numpy() for t, x in ((rows, "id"), (rows, "vid"), (asks, "query_id")))
        s = matrix(asks.column("q").combine_chunks(), c.shape[1]) @ matrix(rows.column("v").combine_chunks(), c.shape[1]).T * unit
        s = np.copysign(np.floor(np.abs(s) + 0.5), s) / unit  # halves away from zero, as SQL rounds
        s[name[:, None] == ids[None]] = -np.inf
        by_id = np.lexsort([vid, ids])
        order = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
        score = np.take_along_axis(s, order, 1)
        q, o = np.nonzero(score > -np.inf)
        at = order[q, o]
        return pa.table({"query_id": asks.column("query_id").take(pa.array(q)), "vec_id": rows.column("id").take(pa.array(at)), "vid": vid[at], "score": score[q, o]})

    begin, end = 0, first
    while True:
        asks = checkpointed(state.mapInArrow(asks_of(begin, end), f"query_id {kind}, q array<double>, ball int, n long, chunks int"))
        if asks.isEmpty():
            return found, seen
        seen = checkpointed(seen.unionByName(asks.groupBy("query_id").agg(F.sum("n").alias("visited"))).groupBy("query_id").agg(F.sum("visited").alias("visited")))
        # Queries of a ball that very many ask are dealt, too; the table has a row a ball.
        parts = asks.groupBy("ball").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
        rows = index.vectors.join(F.broadcast(parts), "ball").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
        asks = asks.join(F.broadcast(parts), "ball").select("ball", "query_id", "q", own, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        key = ("ball", "chunk", "part")
        new = rows.select(*key, "vid", "id", "v").groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(met, f"query_id {kind}, vec_id {kind}, vid long, score double")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "vid")
        found = checkpointed(found.unionByName(new).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r"))
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("new"))
        state = checkpointed(state.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("new", F.lit(-2.0)).alias("kth")))
        begin, end = end, 2 * end
        if begin >= len(held):
            return found, seen
