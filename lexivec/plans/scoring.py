"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexivec.functions.text import words
from lexivec.operators import scoring as S
from lexivec.plans.registry import query, table

_COUNTS = r"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY term),
z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t WHERE len(w) > 0),
b AS (SELECT doc_id, term, tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight
  FROM (SELECT c.doc_id, c.term, c.tf::DOUBLE AS tf, dl, df, n, avgdl FROM c JOIN f USING (term), z))"""


@query("A11", "A12", "S21", sql=f"WITH {_COUNTS} SELECT term, df, tf FROM f")
def tf_df_stats(spark, d):
    return S.document_frequencies(S.term_counts(table(spark, d, "documents")))


@query("F13", "F25", "J8", sql=f"WITH {_COUNTS} SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS best FROM b GROUP BY doc_id")
def tfidf_bm25(spark, d):
    rows = S.bm25(table(spark, d, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("best"))


@query("F14", sql=f"WITH {_COUNTS} SELECT term, round(CASE WHEN df = 1 THEN 0 ELSE 1 / ln(df) END, 9) AS idf FROM f")
def idf_vector(spark, d):
    rows = S.idf_vector(S.document_frequencies(S.term_counts(table(spark, d, "documents"))))
    return rows.select("term", F.round("idf", 9).alias("idf"))


@query("F13", "J8", sql=fr"""
WITH {_COUNTS},
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score FROM q JOIN b USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5""")
def bm25_topk(spark, d):
    queries = table(spark, d, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("term")).distinct()
    weights = S.bm25(table(spark, d, "documents"), terms=queries.select("term").distinct())
    scores = S.query_scores(queries, weights, "item_id").withColumn("score", F.round("score", 6))
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("_r", F.row_number().over(by)).where("_r <= 5").drop("_r")
