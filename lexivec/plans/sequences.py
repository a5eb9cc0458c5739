"""Sequence and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators import crf, generation, model, sequence
from lexivec.operators.vectors import sequences
from lexivec.plans.registry import query, table


@query("T2", "I5", sql="""
WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE / 0.1 AS z, unnest(range(64)) AS token FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, token) AS rank FROM f),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM r WHERE rank <= 8),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
SELECT vec_id, token::INTEGER AS token, rank::INTEGER AS rank, round(z, 6) AS logit FROM b WHERE b < 0.8 OR rank <= 2""")
def topk_topp_filter(spark, d):
    out = sequence.filtered_logits(table(spark, d, "embeddings"), "vec_id", "embedding", top_k=8, top_p=0.8, temperature=0.1, min_keep=2)
    return out.withColumn("logit", F.round("logit", 6))


_STEPS = [[((i * 3 + j * 5) % 7 - 3) / 20 for j in range(5)] for i in range(5)]
_INTO = f"list_transform(range(5), lambda i: {{0}}[i + 1] + ({_STEPS}::DOUBLE[][])[i + 1][j + 1])"


@query("W7", "I9", sql=f"""
WITH RECURSIVE e AS (SELECT vec_id // 8 AS seq, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS k, embedding[1:5]::DOUBLE[] AS e FROM embeddings),
v AS (
  SELECT seq, k, e AS s, [[0], [1], [2], [3], [4]]::BIGINT[][] AS p, e AS z FROM e WHERE k = 1
  UNION ALL
  SELECT v.seq, e.k, list_transform(range(5), lambda j: list_max({_INTO.format("v.s")}) + e.e[j + 1]),
    list_transform(range(5), lambda j: list_append(v.p[list_position({_INTO.format("v.s")}, list_max({_INTO.format("v.s")}))], j)),
    list_transform(range(5), lambda j: ln(list_sum(list_transform({_INTO.format("v.z")}, lambda x: exp(x)))) + e.e[j + 1])
  FROM v JOIN e ON e.seq = v.seq AND e.k = v.k + 1)
SELECT seq, array_to_string(p[list_position(s, list_max(s))], ',') AS path, round(list_max(s), 9) AS score, round(ln(list_sum(list_transform(z, lambda x: exp(x)))), 9) AS log_z
FROM v JOIN (SELECT seq, max(k) AS k FROM e GROUP BY seq) USING (seq, k)""")
def viterbi(spark, d):
    steps = sequences(table(spark, d, "embeddings"), 8)
    rows = steps.select("seq", F.transform("steps", lambda s: F.slice(s["v"], 1, 5)).alias("emissions"))
    best = sequence.decode(rows, "seq", "emissions", np.array(_STEPS))
    return best.select("seq", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), F.round("score", 9).alias("score"), F.round("log_z", 9).alias("log_z"))


@query("I1", "I2", "I4", "K2", "K3", sql=r"""
WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM conversations),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT < 8 THEN 1 ELSE -1 END AS s FROM w),
c AS (SELECT conv_id, turn, b, sum(s) AS s FROM h GROUP BY ALL)
SELECT conv_id, turn, count(*) FILTER (WHERE s <> 0) AS places, sum(sign(s) * (b + 1))::BIGINT AS checksum FROM c GROUP BY ALL""")
def encode_texts(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", model.encode("text", model.EncoderSpec()).alias("v"))
    signs = F.transform("v", lambda x, i: F.signum(x).cast("long") * (i + 1))
    return rows.select(
        "conv_id", "turn", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("places"), F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum")
    )


def _generation_sql(beams: int, max_length: int, min_length: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations),
g AS (SELECT unnest(list_transform(range(len(w) + 1), lambda i: {{'c1': CASE WHEN i < 2 THEN '<s>' ELSE w[i - 1] END, 'c2': CASE WHEN i < 1 THEN '<s>' ELSE w[i] END,
    'token': CASE WHEN i < len(w) THEN w[i + 1] ELSE '</s>' END}})) AS s FROM w WHERE w IS NOT NULL),
n AS (SELECT s.c1 AS c1, s.c2 AS c2, s.token AS token, count(*) AS n FROM g GROUP BY ALL),
m AS (SELECT c1, c2, token, round(ln(n / sum(n) OVER (PARTITION BY c1, c2)) * 1000000)::BIGINT AS logp, row_number() OVER (PARTITION BY c1, c2 ORDER BY n DESC, token) AS place FROM n),
s AS (
  SELECT 0 AS step, conv_id AS id, w[1] AS c1, w[2] AS c2, '' AS text, 0::BIGINT AS score, 0 AS n_tokens, false AS done, false AS ended, 0 AS rank FROM w WHERE turn = 0 AND len(w) >= 2
  UNION ALL
  SELECT step + 1, id, c1, c2, text, score, n_tokens, done, ended, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, text, ended DESC) AS rank FROM (
      SELECT s.step, s.id, CASE WHEN m.token IS NULL THEN s.c1 ELSE s.c2 END AS c1, coalesce(m.token, s.c2) AS c2,
        CASE WHEN m.token IS NULL OR m.token = '</s>' THEN s.text WHEN s.text = '' THEN m.token ELSE s.text || ' ' || m.token END AS text, s.score + coalesce(m.logp, 0) AS score,
        s.n_tokens + (m.token IS NOT NULL AND m.token <> '</s>')::INT AS n_tokens, m.token IS NULL OR m.token = '</s>' AS done, coalesce(m.token = '</s>', false) AS ended
      FROM s LEFT JOIN m ON m.c1 = s.c1 AND m.c2 = s.c2 AND m.place <= {beams + 1} AND (s.step >= {min_length} OR m.token <> '</s>') WHERE NOT s.done AND s.step < {max_length}
      UNION ALL
      SELECT s.step, s.id, s.c1, s.c2, s.text, s.score, s.n_tokens, s.done, s.ended FROM s
      WHERE s.done AND s.step < {max_length} AND s.id IN (SELECT id FROM s WHERE NOT done)))
  WHERE rank <= {beams})
SELECT id, rank::INT AS rank, text, score, n_tokens, ended FROM s JOIN (SELECT id, max(step) AS step FROM s GROUP BY id) USING (id, step)"""


def _prompts(spark, d, beams):
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.words(F.lower("text")).alias("w"))
    first = rows.where((F.col("turn") == 0) & (F.size("w") >= 2))
    prompts = first.select(F.col("conv_id").alias("id"), F.get("w", F.lit(0)).alias("c1"), F.get("w", F.lit(1)).alias("c2"))
    return prompts, generation.next_tokens(rows, "w", beams + 1)


@query("I5", sql=_generation_sql(1, 24, 3))
def generate_greedy(spark, d):
    return generation.generate(*_prompts(spark, d, 1), max_length=24, min_length=3)


@query("I5", sql=_generation_sql(4, 16, 2))
def generate_beams(spark, d):
    return generation.generate(*_prompts(spark, d, 4), beams=4, max_length=16, min_length=2)


@query("I9", "W7")
def crf_tags(spark, d):
    """Roles of the turns of each conversation (in parts of 512 turns): by the length of the turn alone, and by a chain over
    them that is trained on conversations which aren't held out."""
    rows = table(spark, d, "conversations").withColumn("held_out", F.crc32(F.col("conv_id").cast("string")) % 5 == 0)
    rows = rows.withColumn("part", F.floor(F.col("turn") / 512)).withColumn("size", F.log1p(F.length(F.coalesce("text", F.lit("")))))
    known = rows.where("NOT held_out AND role IS NOT NULL").groupBy("role").agg(F.avg("size").alias("mean"), F.coalesce(F.stddev_pop("size"), F.lit(0.0)).alias("sd")).orderBy("role").take(257)
    if len(known) > 256:
        raise ValueError("over 256 labels")
    if not known:
        return rows.select("conv_id", "part", "held_out", *[F.lit("").alias(c) for c in ("roles", "alone", "chained")]).limit(0)
    names = F.array(*[F.lit(r["role"]) for r in known])
    spread = [max(r["sd"], 0.1) for r in known]
    scores = F.array(*[-F.pow((F.col("size") - r["mean"]) / s, 2) / 2 - float(np.log(s)) for r, s in zip(known, spread, strict=True)])
    place = F.array_position(names, F.col("role")) - 1
    turns = rows.select("conv_id", "part", "held_out", F.struct("turn", scores.alias("e"), F.when(place >= 0, place).cast("int").alias("g")).alias("t"))
    key = F.struct("conv_id", "part").cast("string").alias("seq")
    each = turns.groupBy("conv_id", "part", "held_out").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "part", "held_out", key, F.col("t.e").alias("e"), F.col("t.g").alias("g"))
    chain = crf.fit(each.where("NOT held_out"), "e", "g", len(known))
    best = sequence.decode(each.select("seq", chain.started(F.col("e")).alias("e")), "seq", "e", chain.transitions)
    named = lambda places: F.array_join(F.transform(places, lambda p: F.get(names, p)), ",", "")
    alone = F.transform("e", lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    return each.join(best.select("seq", "path"), "seq").select("conv_id", "part", "held_out", named(F.col("g")).alias("roles"), named(alone).alias("alone"), named(F.col("path")).alias("chained"))


_SCORES = "list_transform(range(3), lambda k: ('0x' || substr(md5(t), k + 1, 1))::BIGINT)"


@query("I3", "I1", sql=rf"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
o AS (SELECT conv_id, turn, w[1:4] AS t, sum((length(w) + 3) // 4) OVER (PARTITION BY conv_id, turn ORDER BY i) - (length(w) + 3) // 4 AS pos FROM p)
SELECT conv_id, turn, pos::INTEGER AS pos, t AS token, ['person', 'place', 'none'][list_position({_SCORES}, list_max({_SCORES}))] AS label FROM o""")
def token_words(spark, d):
    """Words of the turns in pieces of four characters, each with three scores (digits of its hash); a word has the label of its first piece."""
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.length(w) - 1, F.lit(4)), lambda o: F.struct(F.substring(w, o + 1, F.lit(4)).alias("t"), o.alias("o")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.flatten(F.transform(X.words(F.col("text")), pieces)).alias("p"))
    scores = lambda t: F.array(*[F.conv(F.substring(F.md5(t), k, 1), 16, 10).cast("double") for k in (1, 2, 3)])
    rows = rows.select("conv_id", "turn", F.col("p.t").alias("t"), F.col("p.o").alias("o"), F.transform("p.t", scores).alias("z"))
    return model.classified_tokens(rows, ["conv_id", "turn"], "t", "o", "z", ["person", "place", "none"])


@query("F26", sql="""
WITH n AS (SELECT lang, ['BertModel', 'RobertaForMaskedLM', 'AlbertModel', 'BartModel', 'ElectraForPreTraining', 'GPT2LMHeadModel', 'Perceiver'][doc_id % 7 + 1] AS class_name FROM documents)
SELECT lang, class_name, ['bert', 'roberta', 'albert', 'model', 'electra', 'transformer'][list_position(['Bert', 'Robe', 'Albe', 'Bart', 'Elec', 'GPT2'], class_name[1:4])] AS attribute, count(*) AS docs FROM n GROUP BY ALL""")
def model_families(spark, d):
    names = F.array(*[F.lit(n) for n in ("BertModel", "RobertaForMaskedLM", "AlbertModel", "BartModel", "ElectraForPreTraining", "GPT2LMHeadModel", "Perceiver")])
    rows = table(spark, d, "documents").select("lang", F.get(names, (F.col("doc_id") % 7).cast("int")).alias("class_name"))
    return rows.groupBy("lang", "class_name").agg(F.count("*").alias("docs")).withColumn("attribute", model.family_attribute(F.col("class_name"), strict=False))
