"""Queries of sentence runs and filled shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators import pretraining as P
from lexivec.plans.registry import query, table

_HEX = "('0x' || substr(md5(concat_ws('|', {0}, '42')), 1, 8))::BIGINT"
_AT = lambda name, place="pos": _HEX.format(f"doc_id, {place}, '{name}'")
_CUT = "CASE WHEN front THEN {0}[{1} + 1:] ELSE {0}[:len({0}) - {1}] END"


@query("B7", "B6", sql=rf"""
WITH RECURSIVE x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
  lambda l: list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')), lambda w: len(w) > 0) AS s FROM documents),
h AS (SELECT doc_id AS other, s, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM x WHERE len(s) > 0),
t AS (SELECT doc_id, unnest(list_transform(s, lambda w: len(w))) AS size, unnest(range(len(s))) AS pos, len(s) AS m FROM x),
p AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, CASE WHEN {_AT("target")} % 1000 < 100 THEN 2 + {_AT("target")} % 124 ELSE 125 END AS target FROM t),
n AS (SELECT p.doc_id, p.pos, any_value(p.m) AS m, coalesce(min(q.pos) + 1, any_value(p.m)) AS stop FROM p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.upto >= p.upto - p.size + p.target GROUP BY p.doc_id, p.pos),
u AS (SELECT *, CASE WHEN stop - pos > 1 THEN 1 + {_AT("split")} % greatest(stop - pos - 1, 1) ELSE 1 END AS split, stop - pos = 1 OR {_AT("coin")} % 2 = 0 AS rnd FROM n),
r AS (
  SELECT doc_id, 0 AS run, 0::BIGINT AS pos FROM x WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, run + 1, CASE WHEN rnd THEN pos + split ELSE stop END FROM r JOIN u USING (doc_id, pos) WHERE CASE WHEN rnd THEN pos + split ELSE stop END < m),
d AS (SELECT r.doc_id, r.run, u.pos, u.stop, u.split, u.rnd, x.s, {_AT("doc")} % (SELECT max(c) FROM h) AS j, {_AT("tail")} % 2 = 0 AS two, {_AT("front")} % 2 = 0 AS front FROM r JOIN u USING (doc_id, pos) JOIN x USING (doc_id)),
e AS (SELECT d.*, coalesce(CASE WHEN g.other = d.doc_id THEN f.s ELSE g.s END, []) AS o FROM d JOIN h g ON g.i = d.j JOIN h f ON f.i = (d.j + 1) % f.c),
b AS (SELECT doc_id, run, pos, stop, rnd, front, flatten(s[pos + 1:pos + split]) AS a, CASE WHEN rnd THEN flatten(o[greatest(len(o) - two::INT, 1):]) ELSE flatten(s[pos + split + 1:stop]) END AS b FROM e),
o AS (SELECT *, greatest(len(a) + len(b) - 125, 0) AS o, len(a) - len(b) AS g FROM b),
c AS (SELECT *, least(greatest(g, 0), o) AS c1, least(greatest(-g, 0), o) AS c2 FROM o),
k AS (SELECT *, c1 + (o - c1 - c2 + 1) // 2 AS k1, c2 + (o - c1 - c2) // 2 AS k2 FROM c),
z AS (SELECT doc_id, run, pos, stop, rnd, {_CUT.format("a", "k1")} AS a, {_CUT.format("b", "k2")} AS b FROM k)
SELECT doc_id, run::INTEGER AS run, pos::INTEGER AS start, stop::INTEGER AS stop, rnd::INTEGER AS is_random, len(a)::INTEGER AS n_first, len(b)::INTEGER AS n_second,
  md5('[CLS] ' || array_to_string(a, ' ') || ' [SEP] ' || array_to_string(b, ' ') || ' [SEP]') AS tokens, repeat('0', (len(a) + 2)::INTEGER) || repeat('1', (len(b) + 1)::INTEGER) AS segments FROM z""")
def sentence_runs(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: X.words(x))
    runs = P.with_segments(P.sentence_runs(table(spark, d, "documents").select("doc_id", lines.alias("s")), "doc_id", "s", 128))
    sizes = [F.size("first").alias("n_first"), F.size("second").alias("n_second")]
    return runs.select("doc_id", "run", "start", "stop", "is_random", *sizes, F.md5(F.array_join("tokens", " ")).alias("tokens"), F.array_join(F.col("segments").cast("array<string>"), "").alias("segments"))


@query("B4", "B3", sql="""
WITH RECURSIVE s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 1)) AS size FROM documents),
r AS (SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id) - 1 AS r, size * 1600 > sum(size) OVER () AS large FROM s WHERE size >= 2),
g AS (
  SELECT 0::BIGINT AS r, list_transform(range(16), lambda i: 0::BIGINT) AS f, 0::BIGINT AS shard, NULL::BIGINT AS doc_id
  UNION ALL
  SELECT g.r + 1, list_transform(g.f, lambda x, i: CASE WHEN i = list_position(g.f, list_min(g.f)) THEN x + r.size ELSE x END), list_position(g.f, list_min(g.f)) - 1, r.doc_id FROM g JOIN r ON r.r = g.r WHERE r.large),
f AS (SELECT unnest(f) AS fill, unnest(range(16)) AS shard FROM g WHERE r = (SELECT max(r) FROM g)),
t AS (SELECT coalesce(sum(size), 0) AS rest FROM r WHERE NOT large),
l AS (SELECT min((rest + upto + j - 1) // j) AS level FROM t, (SELECT sum(fill) OVER (ORDER BY fill, shard) AS upto, row_number() OVER (ORDER BY fill, shard) AS j FROM f)),
i AS (SELECT shard, greatest(level - fill, 0) AS room, sum(greatest(level - fill, 0)) OVER (ORDER BY shard) AS high FROM f, l),
b AS (SELECT doc_id, size, sum(size) OVER (ORDER BY r) - size AS before FROM r WHERE NOT large),
a AS (SELECT doc_id, size, g.shard FROM g JOIN r USING (doc_id) UNION ALL SELECT b.doc_id, size, i.shard FROM b JOIN i ON before >= high - room AND before < high)
SELECT doc_id, size::BIGINT AS size, shard::INTEGER AS shard, CASE WHEN shard < 2 THEN 'test' ELSE 'train' END AS split FROM a""")
def shard_fill(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 1)
    return P.filled_shards(table(spark, d, "documents"), "doc_id", F.size(lines), 16)
