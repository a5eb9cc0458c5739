"""Term statistics, BM25 weights and term-at-a-time ranking.

Documents become (doc, term) rows that are counted before any shuffle; document
frequencies are joined by key, so a frequent term is one row of the frequency table, not a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import words
from lexivec.sources.storage import written


def term_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """``doc``, ``term``, ``tf``, the document's length ``dl`` in tokens, and of texts that begin with the term ``heads``, how many they
    are, and ``head_tokens``, their tokens.  ``terms`` (distinct, of a size that Spark broadcasts where it may) are all that is
    counted besides those beginnings, so that other terms are dropped before the shuffle."""
    tokens = docs.select(F.col(doc), words(F.col(text)).alias("_w")).withColumn("dl", F.size("_w").cast("long"))
    rows = tokens.select(doc, "dl", F.posexplode("_w").alias("_p", "term"))
    if terms is not None:
        rows = rows.join(terms.select("term", F.lit(True).alias("_known")), "term", "left").where("_known OR _p = 0")
    head = F.col("_p") == 0
    counts = rows.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.min("dl").alias("dl"), F.count_if(head).alias("heads"), F.sum(F.when(head, F.col("dl")).otherwise(0)).alias("head_tokens"))
    return counts if terms is None else counts.join(terms.select("term", F.lit(True).alias("known")), "term", "left")


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def collection_size(counts: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and the mean length ``avgdl``, over documents with a token."""
    return counts.agg(F.sum("heads").alias("n_docs"), (F.sum("head_tokens") / F.sum("heads")).alias("avgdl"))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, n_docs: Column, df: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """``tf / (tf + k1 (1 - b + b dl / avgdl)) ln(1 + (N - df + .5) / (df + .5))``."""
    return tf / (tf + k1 * (1 - b + b * dl / avgdl)) * F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, doc: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, terms: DataFrame | None = None) -> DataFrame:
    """``doc``, ``term``, ``weight``; only of ``terms`` if given.

    Counts and frequencies are written once: texts are read and split once, and the join on a frequent term
    has two plain exchanges, so Spark splits that term's rows or broadcasts the frequencies where they are small."""
    counts = written(term_counts(docs, doc, text, terms))
    size = F.broadcast(collection_size(counts))
    if terms is not None:
        counts = counts.where("known")
    frequency = written(document_frequencies(counts).select("term", "df"))
    rows = counts.join(frequency, "term").crossJoin(size)  # one row
    return rows.select(doc, "term", bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col("df"), k1, b).alias("weight"))


def idf_vector(frequencies: DataFrame) -> DataFrame:
    """1 / ln(df), and 0 for terms of a single document."""
    return frequencies.select("term", F.coalesce(F.try_divide(F.lit(1.0), F.log("df")), F.lit(0.0)).alias("idf"))


def query_scores(queries: DataFrame, weights: DataFrame, query: str, doc: str = "doc_id") -> DataFrame:
    """The sum of document weights over a query's distinct terms; unknown terms add nothing."""
    return queries.join(weights, "term").groupBy(query, doc).agg(F.sum("weight").alias("score"))
