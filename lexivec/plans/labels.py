"""Label and conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators import labels as L
from lexivec.operators import metrics as M
from lexivec.operators.text import token_offsets, vocabulary
from lexivec.plans.registry import query, table
from lexivec.plans.texts import _ROLE, _FIRST, _SPECIAL

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("A3", "T3", sql="SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT event_type AS label FROM events)")
def label_vocab(spark, d):
    return L.label_ids(table(spark, d, "events").select("event_type"))


@query("A4", sql="""
SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (
  SELECT 'O' AS label UNION SELECT p || c_mktsegment FROM customer, (SELECT unnest(['B-', 'I-']) AS p))""")
def bio_label_vocab(spark, d):
    return L.bio_label_ids(table(spark, d, "customer").select("c_mktsegment"))


@query("A6", sql=f"SELECT word AS label, idx AS id FROM ({_SPECIAL} UNION ALL {_FIRST.format(_ROLE.format('user'), 3)}) ORDER BY idx")
def vocab_labels(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'")
    return vocabulary(rows, X.words(F.col("text")), ["conv_id", "turn"]).select(F.col("word").alias("label"), F.col("idx").alias("id")).orderBy("idx")


@query("J4", "C1", sql="""
WITH v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT event_type AS label FROM events))
SELECT event_id, id AS label_id FROM events JOIN v ON event_type = label""")
def label_lookup(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return L.with_label_ids(rows, "event_type", L.label_ids(rows.select("event_type"))).select("event_id", "label_id")


@query("F22", "A5", "C1", sql="""
WITH v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT event_type AS label FROM events)), n AS (SELECT max(id) + 1 AS n FROM v),
g AS (SELECT user_id, list(DISTINCT id) AS ids FROM events JOIN v ON event_type = label GROUP BY user_id)
SELECT user_id, list_transform(range(n), lambda i: CASE WHEN list_contains(ids, i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hot FROM g, n""")
def multi_hot(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type")
    ids = L.label_ids(rows.select("event_type"))
    return L.multi_hot_labels(rows, ["user_id"], "event_type", ids, ids.count())


#: Tags made from events of a user: a view begins an entity, a click goes on, others are outside.
_TAGS = """t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  CASE event_id % {0} WHEN 0 THEN 'B-X' WHEN 1 THEN 'I-X' WHEN 2 THEN 'B-Y' WHEN 3 THEN 'I-Y' ELSE 'O' END AS tag FROM events)"""
_SPANS = """m AS (SELECT *, lag(tag) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM {0}),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' AND b <> 'O' AND substr(b, 3) = substr(tag, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS g FROM m),
s AS (SELECT user_id, arg_min(tag, pos) AS f, min(pos) AS first, max(pos) AS last FROM g WHERE tag <> 'O' GROUP BY user_id, g)"""


def _tags(spark, d, modulus):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    tag = F.element_at(F.array(F.lit("B-X"), F.lit("I-X"), F.lit("B-Y"), F.lit("I-Y"), F.lit("O")), (F.least(F.col("event_id") % modulus, F.lit(4)) + 1).cast("int"))
    return table(spark, d, "events").select("user_id", pos.alias("pos"), tag.alias("tag"))


@query("E7", "S6", sql=f"WITH {_TAGS.format(7)}, {_SPANS.format('t')} SELECT user_id, substr(f, 3) AS type, first, last FROM s WHERE f LIKE 'B-%'")
def bio_spans(spark, d):
    return M.bio_spans(_tags(spark, d, 7), ["user_id"], "pos", "tag")


@query("E3", sql=f"""
WITH a AS (WITH {_TAGS.format(7)}, {_SPANS.format('t')} SELECT user_id, f, first, last FROM s WHERE f LIKE 'B-%'),
p AS (WITH {_TAGS.format(8)}, {_SPANS.format('t')} SELECT user_id, f, first, last FROM s WHERE f LIKE 'B-%'),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM a) AS n_ref)
SELECT tp, n_pred, n_ref, round(tp / n_pred, 9) AS precision, round(tp / n_ref, 9) AS recall, round(2 * (tp / n_pred) * (tp / n_ref) / ((tp / n_pred) + (tp / n_ref)), 9) AS f1 FROM c""")
def entity_prf(spark, d):
    reference, predicted = (M.bio_spans(_tags(spark, d, m), ["user_id"], "pos", "tag") for m in (7, 8))
    out = M.span_scores(predicted, reference, ["user_id"])
    return out.select("tp", "n_pred", "n_ref", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("J10", "C2", "S5", sql=f"""
WITH w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS t FROM conversations),
p AS (SELECT conv_id, turn, t[pos + 1] AS token, pos, pos + coalesce(list_sum(list_transform(t[1:pos], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(len(t))) AS pos FROM w)),
s AS (SELECT conv_id, turn, k * 40 AS first, k * 40 + 15 AS last FROM w, (SELECT unnest(range(5)) AS k)),
h AS (SELECT p.conv_id, p.turn, p.pos, min(s.first) AS first FROM p JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn AND p.start < s.last AND p.start + length(token) > s.first GROUP BY ALL),
j AS (SELECT p.conv_id, p.turn, p.pos, h.first, lag(h.first) OVER (PARTITION BY p.conv_id, p.turn ORDER BY p.pos) AS b FROM p LEFT JOIN h USING (conv_id, turn, pos))
SELECT conv_id, turn, pos::INTEGER AS pos, CASE WHEN first IS NULL THEN 'O' WHEN b = first THEN 'I-E' ELSE 'B-E' END AS label FROM j""")
def label_align(spark, d):
    rows = table(spark, d, "conversations")
    tokens = token_offsets(rows, X.words(F.col("text")), ["conv_id", "turn"])
    spans = rows.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    spans = spans.select("conv_id", "turn", F.lit("E").alias("type"), (F.col("k") * 40).alias("first"), (F.col("k") * 40 + 15).alias("last"))
    return L.aligned_labels(tokens, spans, ["conv_id", "turn"])


@query("C4", sql="""
SELECT conv_id, turn, md5(text) AS text, md5(n) AS next_text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL""")
def next_token_pairs(spark, d):
    rows = L.next_pairs(table(spark, d, "conversations"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", F.md5("text").alias("text"), F.md5("next_text").alias("next_text"))


@query("C6", "C5", "S8", "I10", sql="""
WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS c, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r, role FROM conversations),
n AS (SELECT conv_id, turn, q, c, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM p WHERE role = 'user' AND r = 'assistant' AND c <> '')
SELECT md5(q) AS question, md5(c) AS context, n // 8 AS batch, n % 8 AS positive FROM n""")
def cloze_pairs(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(by).alias("context"), F.lead("role").over(by).alias("r"))
    rows = rows.where("role = 'user' AND r = 'assistant' AND context <> ''")
    out = L.cloze_batches(rows.select("conv_id", "turn", "question", "context"), F.struct("conv_id", "turn"), 8)
    return out.select(F.md5("question").alias("question"), F.md5("context").alias("context"), "batch", "positive")


@query("C3", "S7", sql="""
SELECT conv_id, turn, instr(text, ' ') AS start_position, length(text) - instr(reverse(text), ' ') + 1 AS end_position FROM conversations WHERE instr(text, ' ') > 0""")
def span_positions(spark, d):
    rows = table(spark, d, "conversations").where(F.instr("text", " ") > 0)
    return rows.select("conv_id", "turn", F.instr("text", " ").cast("long").alias("start_position"), (F.length("text") - F.instr(F.reverse("text"), " ") + 1).cast("long").alias("end_position"))


@query("C3", sql=f"""
WITH w AS (SELECT conv_id, turn, text, coalesce({_WORDS.format('text')}, []) AS t FROM conversations),
b AS (SELECT *, list_filter(t, lambda x: length(x) = list_max(list_transform(t, lambda y: length(y))))[1] AS longest, t[1:30] AS c FROM w)
SELECT conv_id, turn, array_to_string(['[CLS]'] || c || ['[SEP]'] || list_transform(range(30 - len(c)), lambda i: '[PAD]'), ' ') AS tokens,
  (instr(text, longest) - 1)::INTEGER AS start_position, (instr(text, longest) - 1 + length(longest))::INTEGER AS end_position FROM b""")
def span_offset_rows(spark, d):
    """The span of each text's longest word (the first of them), in characters."""
    rows = table(spark, d, "conversations").withColumn("w", X.words(F.col("text")))
    longest = F.array_max(F.transform("w", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    rows = rows.withColumn("longest", longest).withColumn("at", F.call_function("instr", F.col("text"), F.col("longest")) - 1)
    rows = rows.withColumn("span", F.when(F.col("at").isNotNull(), F.array(F.col("at"), F.col("at") + F.length("longest"))))
    out = L.span_offset_rows(rows, ["conv_id", "turn"], "text", "span", ["start_position", "end_position"], 32)
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query("C8", "F18", sql=f"""
SELECT conv_id, turn, len(t) + 2 AS width, list_transform(range(len(t) + 2), lambda i: 0)::INTEGER[] AS token_type_ids,
  list_transform(range(len(t) + 2), lambda i: CASE WHEN i = 0 OR i = len(t) + 1 THEN 0 ELSE 1 END)::INTEGER[] AS token_mask FROM (SELECT conv_id, turn, {_WORDS.format('text')} AS t FROM conversations)""")
def token_type_zeros(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(X.words(F.col("text"))).alias("n"))
    mask = F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda i: F.when((i == 0) | (i == F.col("n") + 1), 0).otherwise(1))
    return rows.select("conv_id", "turn", (F.col("n") + 2).cast("long").alias("width"), F.array_repeat(F.lit(0), F.col("n") + 2).alias("token_type_ids"), mask.alias("token_mask"))


@query("C2", "C7", "J5", sql=f"""
WITH w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS t FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT conv_id, turn, t, flatten(list_transform(range(len(t)), lambda i: CASE WHEN length(t[i + 1]) > 6 THEN [i, i] ELSE [i] END)) AS k FROM w)
SELECT md5(array_to_string(list_transform(list_concat([-1], k, [-1]), lambda i: CASE WHEN i < 0 THEN -100 ELSE CASE length(t[i + 1]) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END END), ',')) AS labels,
  len(k) + 2 AS width FROM v WHERE len(t) > 0""")
def token_classification_rows(spark, d):
    words = table(spark, d, "conversations").where("conv_id IS NOT NULL").select(X.words(F.col("text")).alias("t")).where(F.size("t") > 0)
    kinds = F.transform("t", lambda w: F.element_at(F.array(F.lit("B-E"), F.lit("I-E"), F.lit("O")), (F.length(w) % 3 + 1).cast("int")))
    pieces = F.flatten(F.transform("t", lambda w, i: F.when(F.length(w) > 6, F.array(i, i)).otherwise(F.array(i))))
    outside = F.array(F.lit(None).cast("int"))
    rows = words.select(F.concat(outside, pieces, outside).alias("word_ids"), kinds.alias("labels"))
    ids = L.bio_label_ids(spark.createDataFrame([("E",)], "label string"))
    out = L.convert(rows, "token_classification", ids)
    return out.select(F.md5(F.array_join("labels", ",")).alias("labels"), F.size("labels").cast("long").alias("width"))


@query("C1", "C7", sql="""
WITH v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL))
SELECT md5(text) AS text, id AS labels FROM documents LEFT JOIN v ON lang = label""")
def sequence_classification_rows(spark, d):
    docs = table(spark, d, "documents").select("text", F.col("lang").alias("label"))
    return L.convert(docs, "sequence_classification", L.label_ids(docs.select("label"))).select(F.md5("text").alias("text"), "labels")
