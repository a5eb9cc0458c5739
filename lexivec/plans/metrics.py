"""Evaluation queries.  Predictions are derived from the tables by fixed rules, alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import vectors as V
from lexivec.operators import metrics as M
from lexivec.operators.relational import dense_ids
from lexivec.plans.registry import query, table

_L = "l AS (SELECT doc_id, quality AS r, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS p FROM labels)"
_CLASS = """k AS (SELECT label, sum(tp) AS tp, sum(np) AS np, sum(nr) AS nr FROM (
  SELECT p AS label, (p = r)::INT AS tp, 1 AS np, 0 AS nr FROM {0} UNION ALL SELECT r, 0, 0, 1 FROM {0}) GROUP BY label),
f AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS p, CASE WHEN nr = 0 THEN 0 ELSE tp / nr END AS r FROM k),
g AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM f)"""


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("E1", "E8", sql=f"""
WITH {_L}, {_CLASS.format('l')} SELECT round(sum(tp) / sum(nr), 9) AS accuracy, round(sum(p * nr) / sum(nr), 9) AS precision, round(sum(r * nr) / sum(nr), 9) AS recall, round(sum(f1 * nr) / sum(nr), 9) AS f1 FROM g""")
def accuracy_prf_weighted(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("r"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"))
    return _rounded(M.classification(rows, "p", "r", "weighted"))


_T = "t AS (SELECT label AS r, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings WHERE vec_id % 11 <> 0)"


@query("E2", "E10", sql=f"""
WITH {_T}, {_CLASS.format('t')} SELECT round(sum(tp) / sum(nr), 9) AS accuracy, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(f1), 9) AS f1 FROM g""")
def prf_macro(spark, d):
    from lexivec.operators.vectors import sequences

    steps = sequences(table(spark, d, "embeddings"), 8, keep=["label", "vec_id"])
    ref = F.transform("steps", lambda s: F.when(s["vec_id"] % 11 == 0, M.IGNORED).otherwise(s["label"]))
    pred = F.transform("steps", lambda s: F.when(s["vec_id"] % 5 == 0, (s["label"] + 1) % 10).otherwise(s["label"]))
    tokens = M.token_rows(steps.select(pred.alias("predictions"), ref.alias("references")), "predictions", "references")
    return _rounded(M.classification(tokens, "p", "r", "macro"))


@query("E4", "F21", sql="""
WITH e AS (SELECT vec_id // 8 AS seq, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 9 <> 0)
SELECT seq, round(exp(avg(-(v[label + 1] - ln(list_sum(list_transform(v, lambda x: exp(x))))))), 6) AS ppl FROM e GROUP BY seq""")
def perplexity(spark, d):
    rows = table(spark, d, "embeddings").where("vec_id % 9 <> 0").withColumn("seq", F.floor(F.col("vec_id") / 8))
    return rows.groupBy("seq").agg(F.round(M.perplexity(F.col("embedding"), F.col("label")), 6).alias("ppl"))


@query("E5", sql="SELECT l_linestatus, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) AS mse, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def mse(spark, d):
    rows = M.mse(table(spark, d, "lineitem"), "l_discount", "l_tax", ("l_linestatus",))
    return rows.withColumn("mse", F.round("mse", 9))


@query("F15", sql="SELECT vec_id, round(ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))), 9) AS lse FROM embeddings")
def log_sum_exp(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.log_sum_exp(F.col("embedding")), 9).alias("lse"))


@query("W4", "I3", sql="SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS best FROM embeddings")
def argmax_predictions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("best"))


@query("E9", "A10", sql="""
WITH s AS (SELECT lang AS task, avg(quality) AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang),
w AS (SELECT lang AS task, count(*) AS weight FROM documents GROUP BY lang UNION ALL SELECT 'none', 100)
SELECT 'eval_' || task AS key, round(score, 9) AS score FROM s UNION ALL SELECT 'eval_all', round(sum(coalesce(score, 0) * weight) / sum(weight), 9) FROM w LEFT JOIN s USING (task)""")
def task_aggregate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("task"))
    scores = docs.join(table(spark, d, "labels"), "doc_id").groupBy("task").agg(F.avg("quality").alias("score"))
    weights = docs.groupBy("task").agg(F.count("*").alias("weight")).unionByName(spark.createDataFrame([("none", 100)], "task string, weight long"))
    each = scores.select(F.concat(F.lit("eval_"), "task").alias("key"), F.round("score", 9).alias("score"))
    return each.unionByName(M.aggregated(scores, weights).select(F.lit("eval_all").alias("key"), F.round("score", 9).alias("score")))


@query("F23", sql="""
SELECT s AS step, round(0.01 / (1 + 0.05 * (s - 1)), 12) AS decayed, round(CASE WHEN s < 100 THEN s * 1e-5 ELSE 1e-3 * pow(s / 100, -0.98) END, 12) AS warmed FROM (SELECT row_number() OVER (ORDER BY ts, event_id) AS s FROM events)""")
def learning_rates(spark, d):
    """The rate at each event, where every event is a step of training."""
    steps = dense_ids(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "step", first=1)
    return steps.select("step", F.round(V.decayed_rate(0.01, 0.05, F.col("step")), 12).alias("decayed"), F.round(V.warmup_rate(1e-5, 100, F.col("step")), 12).alias("warmed"))


@query("E8", "E1", "E4", "E5", "W4", sql=f"""
WITH t AS (SELECT label::BIGINT AS r, list_position(embedding[1:10], list_max(embedding[1:10]))::BIGINT - 1 AS p FROM embeddings), {_CLASS.format('t')}
SELECT 'sequence_classification' AS task, round(sum(f1 * nr) / sum(nr), 9) AS value FROM g
UNION ALL SELECT 'regression', round(avg((l_discount - l_tax) * (l_discount - l_tax)), 9) FROM lineitem
UNION ALL SELECT 'causal_lm', round(exp(avg(-(v[label + 1] - ln(list_sum(list_transform(v, lambda x: exp(x))))))), 6) FROM (SELECT embedding::DOUBLE[] AS v, label FROM embeddings)""")
def metric_dispatch(spark, d):
    scored = table(spark, d, "embeddings").select(F.col("embedding").alias("logits"), F.slice("embedding", 1, 10).alias("predictions"), F.col("label").alias("labels"))
    line = table(spark, d, "lineitem")
    parts = [
        ("sequence_classification", M.evaluated(scored, "sequence_classification"), F.round("f1", 9)),
        ("regression", M.evaluated(line, "regression", predictions="l_discount", references="l_tax"), F.round("mse", 9)),
        ("causal_lm", M.evaluated(scored, "causal_lm", predictions="logits"), F.round("perplexity", 6)),
    ]
    rows = [df.select(F.lit(task).alias("task"), value.alias("value")) for task, df, value in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("E8", "E3", sql="""
WITH t AS (SELECT vec_id // 8 AS id, vec_id % 8 AS pos, vec_id, ['B-X', 'I-X', 'O'] AS names, label % 3 AS r, list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS p FROM embeddings WHERE vec_id % 11 <> 0),
n AS (SELECT 'r' AS side, id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, names[r + 1] AS tag FROM t UNION ALL SELECT 'p', id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1, names[p + 1] FROM t),
m AS (SELECT *, lag(tag) OVER (PARTITION BY side, id ORDER BY pos) AS b FROM n),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' AND b <> 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY side, id ORDER BY pos) AS g FROM m),
s AS (SELECT side, id, min(pos) AS first, max(pos) AS last FROM g WHERE tag <> 'O' GROUP BY side, id, g HAVING arg_min(tag, pos) LIKE 'B-%')
SELECT (SELECT count(*) FROM (SELECT id, first, last FROM s WHERE side = 'p' INTERSECT SELECT id, first, last FROM s WHERE side = 'r')) AS tp,
  count(*) FILTER (side = 'p') AS n_pred, count(*) FILTER (side = 'r') AS n_ref FROM s""")
def token_metric_dispatch(spark, d):
    from lexivec.operators.vectors import sequences

    steps = sequences(table(spark, d, "embeddings"), 8, keep=["label", "vec_id"])
    ref = F.transform("steps", lambda s: F.when(s["vec_id"] % 11 == 0, M.IGNORED).otherwise(s["label"] % 3))
    rows = steps.select(F.col("seq").alias("id"), F.transform("steps", lambda s: F.slice(s["v"], 1, 3)).alias("predictions"), ref.alias("labels"))
    return M.evaluated(rows, "token_classification", names=["B-X", "I-X", "O"]).select("tp", "n_pred", "n_ref")
