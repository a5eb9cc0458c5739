"""Lookup of values in disjoint intervals as an equi-join.

Every interval is cut into the largest aligned blocks of powers of two inside it, two a level at most, however long it is.  A value
lies in one block of each level, so it meets an interval exactly where a block of both is the same: no range
predicate, no scan of all intervals, and no bin that long or many intervals crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 62


def blocks(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """``intervals`` with ``_level``, ``_block``: the blocks of each; both ends (from 0 on) belong to an interval.
    Intervals with a null end or the ends the wrong way round have none."""
    lo, hi = F.col(f"`{low}`").cast("long"), F.col(f"`{high}`").cast("long")
    level = F.col("_level")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    first = F.call_function("shiftright", lo + size - 1, level)  # the first block that starts inside
    last = F.call_function("shiftright", hi + 1, level) - 1  # the last one that ends inside
    fits = lambda b: (b * size >= lo) & ((b + 1) * size - 1 <= hi)
    odd = lambda b: b.bitwiseAND(F.lit(1).cast("long")) == 1
    each = intervals.where(lo <= hi).withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2((hi - lo + 1).cast("double")) + 1e-9).cast("int"))))
    found = F.array_compact(F.array(F.when(odd(first) & fits(first), first), F.when(~odd(last) & fits(last), last)))
    return each.withColumn("_block", F.explode(F.array_distinct(found)))


def lookup(rows: DataFrame, value: str, intervals: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """``rows`` with ``name`` of the interval that holds their value; null outside all intervals.  Intervals must be disjoint."""
    cut = blocks(intervals.select(low, high, name), low, high).select("_level", "_block", F.col(name).alias("_name"))
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # LEVELS rows at most
    v = F.col(f"`{value}`").cast("long")
    if not levels:
        return rows.withColumn(name, F.lit(None).cast(intervals.schema[name].dataType))
    values = rows.select(v.alias("_v")).where("_v IS NOT NULL").distinct()
    places = F.array(*[F.struct(F.lit(x).alias("_level"), F.shiftright("_v", x).alias("_block")) for x in levels])
    met = values.select("_v", F.explode(places).alias("_p")).select("_v", "_p._level", "_p._block").join(cut, ["_level", "_block"]).select("_v", "_name")
    return rows.withColumn("_v", v).join(met, "_v", "left").drop("_v").withColumnRenamed("_name", name)


def ranges_of(values: DataFrame, value: str, name: Column, most: int = 1 << 21) -> DataFrame:
    """``low``, ``high``, ``name``: runs of consecutive values with one name, of a closed set of values (code points: ``most`` at most)."""
    if values.count() > most:
        raise ValueError(f"more than {most} values")
    by = Window.partitionBy("name").orderBy("v")
    named = values.select(F.col(value).cast("long").alias("v"), name.alias("name")).where("name IS NOT NULL")
    return named.withColumn("run", F.col("v") - F.row_number().over(by)).groupBy("name", "run").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("low", "high", "name")
