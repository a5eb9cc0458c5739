"""Corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators import corpus as C
from lexivec.plans.registry import query, table

_HEX = "('0x' || substr(md5(concat_ws('|', {0}, '42')), 1, 8))::BIGINT"
_LINES = """n AS (SELECT source, doc_id, unnest(string_split('= ' || doc_id || ' =' || chr(10) || text, chr(10))) AS line,
  unnest(range(len(string_split('= ' || doc_id || ' =' || chr(10) || text, chr(10))))) AS k FROM documents)"""


def _dump(spark, d):
    """The documents as one dump: a title line, then the lines of the text."""
    text = F.concat(F.lit("= "), F.col("doc_id"), F.lit(" =\n"), F.col("text"))
    return table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split(text, "\n")).alias("k", "line"))


@query("B1", "S17", "W5", "F3", "F4", "F5", "K8", sql=fr"""
WITH {_LINES}, t AS (SELECT *, regexp_matches(line, '^(=\s*)[^=\s]') AND NOT regexp_matches(line, '^(=\s*){{2,}}') AS s FROM n),
g AS (SELECT *, sum(s::INT) OVER (ORDER BY source, doc_id, k) AS article FROM t),
b AS (SELECT article, source, doc_id, k, trim(x) AS x, j FROM (SELECT *, unnest(regexp_split_to_array(replace(regexp_replace(line, '\p{{Cf}}', '', 'g'), '다.', '다.' || chr(10)), chr(10) || '+')) AS x,
  unnest(range(len(regexp_split_to_array(replace(regexp_replace(line, '\p{{Cf}}', '', 'g'), '다.', '다.' || chr(10)), chr(10) || '+')))) AS j FROM g WHERE NOT s AND length(line) >= 2))
SELECT article::BIGINT AS article, (SELECT max(trim(line, '= ')) FROM g h WHERE h.article = a.article AND s) AS title,
  md5(coalesce((SELECT string_agg(x, chr(8232) ORDER BY k, j) FROM b WHERE b.article = a.article), '')) AS line FROM (SELECT DISTINCT article FROM g WHERE article > 0) a""")
def line_documents(spark, d):
    return C.articles(_dump(spark, d), ["source", "doc_id", "k"], "line").select("article", "title", F.md5("line").alias("line"))


@query("B5", "W5", sql="""
SELECT row_number() OVER (ORDER BY source, doc_id, b) - 1 AS doc, n_lines, chars FROM (
  WITH n AS (SELECT source, doc_id, unnest(string_split(text || chr(10), chr(10))) AS line, unnest(range(len(string_split(text || chr(10), chr(10))))) AS k FROM documents),
  g AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY source, doc_id ORDER BY k) AS b FROM n)
  SELECT source, doc_id, b, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM g WHERE trim(line) <> '' GROUP BY ALL)""")
def blank_line_docs(spark, d):
    from lexivec.operators.relational import dense_ids

    lines = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n")), "\n")).alias("k", "line"))
    found = C.blank_separated(lines, ["source", "doc_id", "k"], "line")
    return dense_ids(found.withColumnRenamed("doc", "_d"), ["_d"], "doc").select("doc", "n_lines", "chars")


@query("W6", sql=r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id || '.' || turn AS doc, md5(array_to_string(w, ' ')) AS text FROM w WHERE len(w) > 0""")
def morpheme_documents(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    rows = rows.select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("pos").cast("string")).alias("id"), "word")
    return C.word_documents(rows, "id", "word").select("doc", F.md5("text").alias("text"))


@query("B2", "S16", sql="SELECT ceil(sum(strlen(text)) / 65536)::BIGINT AS shards, ceil(ceil(sum(strlen(text)) / 65536) * 0.1)::BIGINT AS test_shards FROM documents")
def shard_count(spark, d):
    return C.shard_count(table(spark, d, "documents"), "text", 65536)


_PLAN = """s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 1)) AS sentences FROM documents),
r AS (SELECT *, (row_number() OVER (ORDER BY sentences DESC, doc_id) - 1) % 32 AS p FROM s WHERE sentences >= 2),
q AS (SELECT doc_id, sentences, CASE WHEN p < 16 THEN p ELSE 31 - p END AS shard FROM r)"""


def _plan(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 1)
    return C.shard_plan(table(spark, d, "documents"), "doc_id", F.size(lines), 16)


@query("B3", "B4", "F6", "K9", sql=f"WITH {_PLAN} SELECT *, CASE WHEN shard < 2 THEN 'test' ELSE 'train' END AS split FROM q")
def shard_plan(spark, d):
    return _plan(spark, d)


@query("A9", sql=f"""
WITH {_PLAN}, t AS (SELECT shard, sum(sentences) AS n FROM q GROUP BY shard) SELECT count(*) AS shards, max(n)::BIGINT AS most, sum(n)::BIGINT AS total, median(n)::DOUBLE AS middle FROM t""")
def shard_balance(spark, d):
    sizes = _plan(spark, d).groupBy("shard").agg(F.sum("sentences").alias("n"))
    return sizes.agg(F.count("*").alias("shards"), F.max("n").alias("most"), F.sum("n").alias("total"), F.percentile("n", 0.5).alias("middle"))


@query("B2", "B4", sql=f"WITH {_PLAN} SELECT CASE WHEN shard < 2 THEN 'test' ELSE 'train' END AS split, count(*) AS docs, sum(sentences)::BIGINT AS sentences FROM q GROUP BY 1")
def train_test_split(spark, d):
    return _plan(spark, d).groupBy("split").agg(F.count("*").alias("docs"), F.sum("sentences").alias("sentences"))


_SENT = """x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM documents),
s AS (SELECT doc_id, unnest(s) AS t, unnest(range(len(s))) AS pos FROM x)"""


_TARGET = "CASE WHEN " + _HEX.format("doc_id, {0}") + " % 1000 < 100 THEN 2 + " + _HEX.format("doc_id, {0}") + " % 124 ELSE 125 END"


@query("B6", "K10", sql=rf"""
WITH RECURSIVE {_SENT},
z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS m,
  len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM s),
v AS (
  SELECT doc_id, i, m, 0 AS k, 1 AS n, size AS tokens, {_TARGET.format("0")} AS target FROM z WHERE i = 1
  UNION ALL
  SELECT doc_id, i, m, k, n, tokens, {_TARGET.format("k")} FROM (
    SELECT z.doc_id, z.i, z.m, v.k + (v.tokens >= v.target)::INT AS k, CASE WHEN v.tokens >= v.target THEN 1 ELSE v.n + 1 END AS n, CASE WHEN v.tokens >= v.target THEN z.size ELSE v.tokens + z.size END AS tokens
    FROM v JOIN z ON z.doc_id = v.doc_id AND z.i = v.i + 1))
SELECT doc_id, k::BIGINT AS example, n::BIGINT AS n_sentences, least(tokens, 125)::BIGINT AS n_tokens, target::BIGINT AS target FROM v WHERE tokens >= target OR i = m""")
def pack_chunks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("s"))
    return C.packed_examples(rows, "doc_id", "s", 128)


@query("B7", sql=f"""
WITH {_SENT}, h AS (SELECT doc_id, arg_min(t, pos) AS head, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM s GROUP BY doc_id), c AS (SELECT count(*) AS c FROM h),
n AS (SELECT doc_id, pos, t, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM s),
r AS (SELECT n.*, h.i, c, ({_HEX.format('doc_id, pos')} % 2 = 0)::INT AS rnd, (i + 1 + {_HEX.format("doc_id, pos, 'doc'")} % (c - 1)) % c AS j FROM n JOIN h USING (doc_id), c WHERE nx IS NOT NULL)
SELECT r.doc_id, pos::INTEGER AS pos, md5(t) AS first, md5(CASE WHEN rnd = 1 THEN h.head ELSE nx END) AS second, rnd AS is_random FROM r LEFT JOIN h ON h.i = r.j""")
def nsp_pairs(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("pos", "t"))
    return C.sentence_pairs(rows, "doc_id", "pos", "t").select("doc_id", "pos", F.md5("first").alias("first"), F.md5("second").alias("second"), "is_random")


@query("B8", sql=r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(len(w))) AS pos, len(w) AS n FROM w),
h AS (SELECT *, md5(concat_ws('|', conv_id, turn, pos, '42')) AS h FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY h) AS r FROM h)
SELECT conv_id, turn, pos::INTEGER AS pos, CASE WHEN x < 8 THEN 'mask' WHEN x = 8 THEN 'keep' ELSE 'replace' END AS action
FROM (SELECT *, ('0x' || substr(h, 9, 8))::BIGINT % 10 AS x FROM r WHERE r <= least(greatest(floor(n * 0.15), 1), 20))""")
def mlm_masks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("pos", "token"))
    return C.masked_positions(rows, ["conv_id", "turn"], "pos")


@query("B7", sql=r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, len(w) AS a, lead(len(w)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w),
o AS (SELECT *, greatest(a + b - 60, 0) AS o, a - b AS g FROM p WHERE b IS NOT NULL),
c AS (SELECT *, least(greatest(g, 0), o) AS c1, least(greatest(-g, 0), o) AS c2 FROM o)
SELECT conv_id, turn, a - c1 - ceil((o - c1 - c2) / 2)::BIGINT AS n_first, b - c2 - ((o - c1 - c2) // 2) AS n_second FROM c""")
def truncated_pairs(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select("conv_id", "turn", X.words(F.col("text")).alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    first, second = C.truncated_pair(F.col("a"), F.col("b"), 60, C.hash_number(F.col("conv_id"), F.col("turn")) % 2 == 0)
    return rows.select("conv_id", "turn", F.size(first).cast("long").alias("n_first"), F.size(second).cast("long").alias("n_second"))


@query("B8", sql=r"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, unnest(w) AS t, unnest(range(len(w))) AS pos, len(w) AS n FROM w),
v AS (SELECT t AS word, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM p)), c AS (SELECT count(*) AS c FROM v),
h AS (SELECT *, md5(concat_ws('|', conv_id, turn, pos, '42')) AS h FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY h) AS r FROM h),
a AS (SELECT *, r <= least(greatest(floor(n * 0.15), 1), 20) AS chosen, ('0x' || substr(h, 9, 8))::BIGINT % 10 AS x, ('0x' || substr(h, 17, 8))::BIGINT % c AS idx FROM r, c)
SELECT conv_id, turn, pos::INTEGER AS pos, CASE WHEN chosen AND x < 8 THEN '[MASK]' WHEN chosen AND x > 8 THEN word ELSE t END AS input, CASE WHEN chosen THEN t END AS label FROM a LEFT JOIN v USING (idx)""")
def mlm_examples(spark, d):
    from lexivec.operators.relational import dense_ids

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("pos", "token"))
    words = dense_ids(rows.select(F.col("token").alias("word")).distinct(), ["word"], "idx")
    return C.masked_examples(rows, ["conv_id", "turn"], "pos", "token", words)
