"""Projection, grouping, sampling, batching and dense numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.text import stable_hash
from lexivec.sources.storage import checkpointed


def select_fields(df: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """The named columns in the table's order; none named means all."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not fields or c in fields])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise before any job runs if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def is_subset_schema(needed: DataFrame, given: DataFrame) -> bool:
    return set(needed.schema.names) <= set(given.schema.names)


def non_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither null nor empty; reaches the scan."""
    return df.where(F.col(f"`{column}`") != "")


def first_per_group(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of each group's first row in ``order``; aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def joined_per_group(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], glue: str = "\n") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, value)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[value]), glue).alias(value))


def capped(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of an order; tasks keep n each."""
    return df.orderBy(*order).limit(n)


def hash_sample(df: DataFrame, key: Column, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, by a hash of their key: the same rows wherever and however often it runs."""
    return df.where(F.substring(stable_hash(key, seed=seed), 1, 8) < f"{int(share * 2**32):08x}")


def reservoir(df: DataFrame, key: Column, k: int, seed: int = 42, whole: bool = False) -> DataFrame:
    """A uniform sample of k rows: those with the smallest hashes.  With ``whole``, fewer than k rows raise."""
    if whole:
        _enough(df, k)
    return df.withColumn("_h", stable_hash(key, seed=seed)).orderBy("_h").limit(k).drop("_h")


def _enough(df: DataFrame, k: int) -> None:
    if df.limit(k).count() < k:
        raise ValueError(f"fewer than {k} rows")


def replacing_sample(df: DataFrame, order: Sequence[Column | str], key: Column, k: int, seed: int = 42) -> DataFrame:
    """``slot`` (0 to k - 1) and the row that holds it at the end: the first k rows fill the slots in a hashed order, and
    each later row n takes slot ``hash % (n + 1)`` if that is one.  Who took a slot last is a maximum by slot, so no
    row waits for another.  Fewer than k rows raise."""
    _enough(df, k)
    row = F.struct(*df.columns)
    drawn = F.conv(F.substring(stable_hash(key, seed=seed), 1, 8), 16, 10).cast("long")
    rows = dense_ids(df.withColumn("_drawn", drawn), order, "_n").withColumn("_row", row)
    first = rows.where(F.col("_n") < k).withColumn("slot", F.row_number().over(Window.orderBy("_drawn", "_n")).cast("long") - 1)  # k rows
    later = rows.where(F.col("_n") >= k).withColumn("slot", F.col("_drawn") % (F.col("_n") + 1)).where(F.col("slot") < k)
    return first.unionByName(later).groupBy("slot").agg(F.max_by("_row", "_n").alias("_row")).select("slot", "_row.*")


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str = "id", first: int = 0) -> DataFrame:
    """Consecutive numbers in an order, without bringing all rows into one task: rows are dealt into ranges,
    counted by range, and numbered within it from the sum of the ranges before."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.withColumn("_dense_o", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])).repartitionByRange("_dense_o")
    dealt = dealt.sortWithinPartitions("_dense_o").withColumn("_dense_p", F.spark_partition_id()).withColumn("_dense_i", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.drop("_dense_o"))  # range bounds are sampled, so both uses must see the same ranges
    counts = dealt.groupBy("_dense_p").agg(F.count("*").alias("_dense_n"), F.min("_dense_i").alias("_dense_low"))
    before = counts.withColumn("_dense_before", F.coalesce(F.sum("_dense_n").over(Window.orderBy("_dense_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select("_dense_p", "_dense_before", "_dense_low")  # a row per partition
    numbered = dealt.join(F.broadcast(before), "_dense_p")
    return numbered.withColumn(name, F.col("_dense_before") + F.col("_dense_i") - F.col("_dense_low") + first).drop("_dense_p", "_dense_i", "_dense_before", "_dense_low")


def batch_ids(df: DataFrame, order: Sequence[Column | str], size: int, name: str = "batch_id") -> DataFrame:
    return dense_ids(df, order, "_row").withColumn(name, F.floor(F.col("_row") / size)).drop("_row")


def newest(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The n largest values of a column (snapshot names sort by time)."""
    return df.select(column).distinct().orderBy(F.desc(column)).limit(n)


def epochs(df: DataFrame, n: int) -> DataFrame:
    """Every row once in each of n epochs."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def choice_by_epoch(df: DataFrame, column: str, n_epochs: int) -> DataFrame:
    """For each epoch the value at place ``epoch % values`` of the sorted distinct values (file names: a listing, small)."""
    values = df.select(column).distinct().withColumn("_k", F.row_number().over(Window.orderBy(column)) - 1)
    total = values.agg(F.count("*").alias("_n"))
    wheel = df.sparkSession.range(n_epochs).withColumnRenamed("id", "epoch").crossJoin(F.broadcast(total))
    return wheel.where("_n > 0").withColumn("_k", F.pmod("epoch", "_n")).join(F.broadcast(values), "_k").select("epoch", column)


def interleaved(tasks: DataFrame, task: str, batches: str, seed: int = 42) -> DataFrame:
    """Task names, each as often as it has batches, in a hashed order."""
    each = tasks.select(task, F.explode(F.when(F.col(batches) > 0, F.sequence(F.lit(0), F.col(batches).cast("int") - 1))).alias("batch"))
    return dense_ids(each, [stable_hash(F.col(task), F.col("batch"), seed=seed), task, "batch"], "position")


def followed(links: DataFrame) -> DataFrame:
    """``id``, ``last``: the end of the chain that starts at each ``id`` of ``links`` (``id``, ``next``, no cycles).
    Each round looks twice as far ahead and is checkpointed."""
    step = checkpointed(links.select("id", F.col("next").alias("last")))
    while True:
        ahead = step.select(F.col("id").alias("last"), F.col("last").alias("then"))
        step = checkpointed(step.join(ahead, "last", "left").select("id", F.coalesce("then", "last").alias("last"), F.col("then").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        step = step.drop("moved")


MAP_WORDS = 1 << 17


def likely_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` (a long) may be one of ``keys``, by a bitmap of ``MAP_WORDS`` longs: a broadcast that
    never grows.  Where it fills up, more rows stay; none is lost."""
    word = F.pmod(F.shiftright(key, 6), F.lit(MAP_WORDS)).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    near = rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return near.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)
