"""Approximate nearest neighbours by cross-polytope hashing.

1. Vectors fall into bands by norm, an eighth of an octave wide, in which the largest inner product is the smallest
   angle but for 5 %.  Vectors of bands with ``exact`` vectors or fewer are scored against every query, so that rare norms
   are never missed; those of larger bands are hashed by their direction.  Widths are searched one by one.
2. Each of ``tables`` hash functions applies three rounds of random signs and a fast Hadamard transform (a
   pseudo-rotation) and takes the nearest signed axis as the bucket.
3. A query looks into the buckets of a table whose axes are nearest to it (multiprobe): ``probes`` of
   128 buckets or fewer, and the same share of more.
4. Rows are dealt by (table, bucket, chunk): the vectors of a bucket and the queries that ask it are each cut into chunks of about
   ``chunk`` by a hash of the ids, and every pair of chunks is a group of its own.  Tasks score the candidates they meet in double precision on the original vectors and
   return the best ``k`` of each query; a last aggregation merges those.

Every row is indexed; nothing is capped.  Of equal vectors in a chunk only the ``k`` + 1 smallest ids can be
among the nearest, and only those are scored.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components, and rows with
a null id, take no part; a query meets vectors of its own width; of rows that repeat an id the smallest vector counts;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import checkpointed


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit vectors and padded to a power of two."""
    x = x / np.abs(x).max(1, keepdims=True)
    out = np.zeros((len(x), max(2, 1 << (x.shape[1] - 1).bit_length())))
    out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def band(vector: Column) -> Column:
    """The number of the norm's eighth of an octave."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    square = F.aggregate(F.zip_with(vector, F.array_repeat(top, F.size(vector)), lambda x, m: x.cast("double") / m), F.lit(0.0), lambda a, x: a + x * x)
    return F.floor(8 * F.log2(top) + 4 * F.log2(square) + 0.5)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def nearest(df: DataFrame, *, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 14, probes: int = 8, chunk: int = 4096, exact: int = 4096, seed: int = 11) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest found for each query."""
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = checkpointed(rows.withColumn("w", F.size("v")).withColumn("band", band(F.col("v"))))
    # At most rows / exact bands are large.
    large = rows.groupBy("w", "band").agg(F.count("*").alias("n")).where(F.col("n") > exact).select("w", "band", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), ["w", "band"], "left").select("id", "v", F.coalesce("q", F.lit(False)).alias("q"), "w", F.coalesce("large", F.lit(False)).alias("large"))
    value = rows.schema["v"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            widths = whole.column(3).to_numpy()
            for width in np.unique(widths):
                own = whole.take(pa.array(np.flatnonzero(widths == width)))
                for start in range(0, own.num_rows, 1000):
                    yield from of_width(own.slice(start, 1000), int(width))

    def of_width(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
        x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        q, large = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 4))
        rare, q, data = np.flatnonzero(~large), np.flatnonzero(q), np.flatnonzero(large)

        def placed(t: int, bucket: np.ndarray, own: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
            take = pa.array(np.r_[own, asks])
            columns = [np.full(len(take), width, np.int32), np.full(len(take), t, np.int32), bucket.astype(np.int32), np.arange(len(take)) >= len(own)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(take), batch.column(1).take(take)], ["w", "t", "b", "ask", "id", "v"])

        yield placed(-1, np.zeros(len(rare) + len(q)), rare, q)
        for t in range(tables):
            r = rotate(x, t, seed)
            axis = np.abs(r[data]).argmax(1)
            bucket = 2 * axis + (r[data, axis] < 0)
            share = max(probes, -(-probes * 2 * r.shape[1] // 128))
            near = np.argsort(-np.stack([r[q], -r[q]], axis=2).reshape(len(q), 2 * r.shape[1]), axis=1, kind="stable")[:, :share]
            yield placed(t, np.r_[bucket, near.ravel()], data, np.repeat(q, near.shape[1]))

    dealt = rows.mapInArrow(hashed, f"w int, t int, b int, ask boolean, id long, v {value}")
    # One row per bucket, however large the input is.
    sizes = dealt.groupBy("w", "t", "b").agg(F.count_if(~F.col("ask")).alias("n"), F.count_if("ask").alias("m")).where(F.greatest("n", "m") > chunk)
    sizes = sizes.select("w", "t", "b", *[F.greatest(F.ceil(F.col(c) / chunk), F.lit(1)).cast("int").alias(p) for c, p in (("n", "parts"), ("m", "asks"))])
    dealt = dealt.join(F.broadcast(sizes), ["w", "t", "b"], "left").fillna(1, ["parts", "asks"])
    own = lambda p: F.pmod(F.xxhash64("id"), F.col(p)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("ask"), F.col("parts")).otherwise(F.col("asks")) - 1))
    dealt = dealt.withColumn("other", copies).select(
        "w", "t", "b", F.when(F.col("ask"), F.col("other")).otherwise(own("parts")).alias("c"), F.when(F.col("ask"), own("asks")).otherwise(F.col("other")).alias("s"), "ask", "id", "v"
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        w = table.column("w").to_numpy()
        begin = np.cumsum(w) - w
        ids, ask = table.column("id").to_numpy(), table.column("ask").to_numpy()
        key = np.stack([table.column(c).to_numpy() for c in ("w", "t", "b", "c", "s")])
        order = np.lexsort([ids, ask, *key[::-1]])
        key = key[:, order]
        edge = np.r_[np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)]), len(order)]
        best: list[tuple] = []
        held = 0
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = order[a:b]
            q, x = own[ask[own]], own[~ask[own]]
            if len(q) and len(x):
                vectors = lambda r: flat[begin[r][:, None] + np.arange(w[r[0]])].astype(float)
                best.append(best_of(ids[q], vectors(q), ids[x], vectors(x), k))
                held += len(best[-1][0])
                if held > 500_000:
                    best = [merged(best, k)]
                    held = len(best[0][0])
        if best:
            query, vec, score = merged(best, k)
            for i in range(0, len(query), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(query[s]), pa.array(vec[s]), pa.array(score[s])], ["query_id", "vec_id", "score"])

    found = dealt.repartition("w", "t", "b", "c", "s").mapInArrow(scored, "query_id long, vec_id long, score double").distinct()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(query: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of the block's vectors for each query, by exact score, then id."""
    order = np.lexsort([ids, *x.T])
    ids, x = ids[order], x[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(1)]
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    ids, x = ids[place <= k], x[place <= k]  # of equal vectors, larger ids never win
    out = []
    for s in range(0, len(query), 256):
        rough = q[s : s + 256] @ x.T
        rough[query[s : s + 256, None] == ids[None]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
        i, j = np.nonzero((rough >= (least - 1e-9 * np.abs(least) - 1e-12)[:, None]) & (rough > -np.inf)) if len(ids) > k else np.nonzero(rough > -np.inf)
        score = np.concatenate([(q[s + i[m : m + 20_000]] * x[j[m : m + 20_000]]).sum(1) for m in range(0, len(i), 20_000)] or [np.zeros(0)])
        out.append((query[s + i], ids[j], score))
    return merged(out, k)


def merged(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` different candidates of each query."""
    query, vec, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([vec, -score, query])
    query, vec, score = query[order], vec[order], score[order]
    if not len(query):
        return query, vec, score
    same = np.r_[False, (query[1:] == query[:-1]) & (vec[1:] == vec[:-1])]
    query, vec, score = query[~same], vec[~same], score[~same]
    new = np.r_[True, query[1:] != query[:-1]]
    place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    return query[place < k], vec[place < k], score[place < k]
