"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.sources.storage import checkpointed, fresh_path, shared_folder, written

__all__ = ["checkpointed", "fresh_path", "likely_in", "only", "row_key", "shared_folder", "spread", "table", "written"]

MAP_WORDS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_column: str, text: str) -> Column:
    """128 bits that name a row by its id and text, the same in every evaluation, whatever
    the partitioning; rows that repeat both share it."""
    i, t = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    return F.struct(F.xxhash64(i, t).alias("a"), F.xxhash64(F.lit(1), t, F.lit(2), i).alias("b"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than the cluster has cores
    (one small file); at scale the file splits stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, resolved exactly, so that extra columns of an
    input (also ones named like a result) can neither travel along nor clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def likely_in(rows: DataFrame, keys: DataFrame, key: str, without: bool = False, words: int = MAP_WORDS) -> DataFrame:
    """Rows whose ``key`` may be one of ``keys``, by a bitmap of ``words`` longs: a broadcast that never grows.
    Where it fills up, more rows stay; none is lost.  ``without`` gives all the other rows."""
    word = F.pmod(F.shiftright(key, 6), F.lit(words)).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    near = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    inside = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return near.where(~inside if without else inside).select(*[F.col(f"`{c}`") for c in rows.columns])
