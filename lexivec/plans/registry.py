"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]  # operator ids of OPERATORS.md
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None):
    """Register a builder under its function's name."""

    def add(build):
        QUERIES[build.__name__] = Query(build, covers, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer file splits than there are cores (one small file) are dealt out, as all work on them
    follows the scan.  At scale the splits stay as they are, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df
