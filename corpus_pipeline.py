"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  All but the
last return the columns of ``docs``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import linededup, packing, secrets, simhash, toxicity
from lexivec.llm.common import only, table, written
from lexivec.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return toxicity.score(rows, model, keep=("row",)).where("NOT toxic").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = linededup.drop_recurring_lines(docs)
    size = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = secrets.secret_spans(rows, keep=("row",))
    found = found.select("row", secrets.redacted(F.col("row.text"), F.col("spans")).alias("clean"), F.size("spans").alias("n"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n") > 0, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(only(docs, "doc_id", "text"), vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
