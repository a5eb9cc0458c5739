"""Tables made from texts: segments, offsets, vocabularies, character classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators.intervals import ranges_of
from lexivec.operators.relational import dense_ids

SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")


def script_ranges(spark: SparkSession) -> DataFrame:
    """``low``, ``high``, ``script``: the runs of code points of each script among ``SCRIPTS``, worked out from the classes that the JVM knows."""
    points = spark.range(0, 0x110000).where("id < 55296 OR id > 57343")  # all but surrogates
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), F.lit("UTF-32"))
    named = points.select("id", X.script(char).alias("s"))
    return ranges_of(named.where("s <> 'Unknown'"), "id", F.col("s")).withColumnRenamed("name", "script")


def character_classes(df: DataFrame, text: str) -> DataFrame:
    """``script``, ``category`` and ``n``: characters are counted first, and each different one is classified once."""
    chars = df.select(F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.groupBy(X.script(F.col("ch")).alias("script"), X.category(F.col("ch")).alias("category")).agg(F.sum("n").alias("n"))


def script_ranges(spark) -> DataFrame:
    """``low``, ``high``, ``script``: runs of code points of one script, from the engine's own character data."""
    points = spark.range(0, 0x110000, 1, 8).where("id < 55296 OR id >= 57344")
    ch = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")
    kinds = points.select("id", X.script(ch).alias("script")).where("script <> 'Unknown'")
    run = F.col("id") - F.row_number().over(Window.partitionBy("script").orderBy("id"))
    return kinds.withColumn("run", run).groupBy("script", "run").agg(F.min("id").alias("low"), F.max("id").alias("high")).select("low", "high", "script")


def token_offsets(df: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    """``keys``, ``pos``, ``start``, ``stop`` of tokens in their text, joined by single spaces; ``keys`` name a text."""
    flat = df.select(*keys, F.posexplode(tokens).alias("pos", "token"))
    before = F.coalesce(F.sum(F.length("token")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("pos") + before
    return flat.select(*keys, "pos", start.alias("start"), (start + F.length("token")).alias("stop"))


def vocabulary(df: DataFrame, tokens: Column, order: list[str], specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """``word`` and ``idx``: specials first, then words by first appearance."""
    seen = df.select(F.posexplode(tokens).alias("pos", "word"), *order)
    first = seen.groupBy("word").agg(F.min(F.struct(*order, "pos")).alias("at"))
    first = first.where(~F.col("word").isin(*specials))
    known = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(specials)], "word string, idx long")
    return known.unionByName(dense_ids(first, ["at"], "idx", len(specials)).select("word", "idx"))


def merge_vocabulary(base: DataFrame, more: DataFrame) -> DataFrame:
    """Unseen words of ``more`` are appended in its order, from the next free number."""
    start = base.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n")).first()["n"]
    new = dense_ids(more.join(base.select("word"), "word", "left_anti"), ["idx"], "new", start)
    return base.unionByName(new.select("word", F.col("new").alias("idx")))


def without_words(base: DataFrame, words: DataFrame) -> DataFrame:
    """Removed words leave gaps; numbers are never used again."""
    return base.join(words.select("word"), "word", "left_anti")


def slot_words(domain: Column, slot: Column) -> Column:
    """The words under which slots enter a vocabulary."""
    return F.concat_ws("-", domain, F.regexp_replace(slot, "-", " "))


def word_counts(df: DataFrame, text: str, least: int) -> DataFrame:
    counts = df.select(F.explode(X.words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)
