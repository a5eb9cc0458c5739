"""Relational queries: scans, filters, groups, samples, batches, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.operators import relational as R
from lexivec.plans.registry import query, table

_H = "md5(concat_ws('|', {0}, '42'))"


@query("S1", "S3", "P1", "P2", sql="SELECT event_id, ts, event_type FROM events")
def scan_project(spark, d):
    return R.select_fields(table(spark, d, "events"), ["event_id", "event_type", "ts"])


@query("S4", "P3", sql="SELECT event_id, event_type FROM events WHERE event_type <> ''")
def filter_nonempty_id(spark, d):
    return R.non_empty(table(spark, d, "events"), "event_type").select("event_id", "event_type")


@query("S8", "P4", sql="SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND text <> ''")
def filter_flag(spark, d):
    return table(spark, d, "conversations").where((F.col("role") == "assistant") & (F.col("text") != "")).select("conv_id", "turn")


@query("A1", sql="""
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_per_group(spark, d):
    return R.first_per_group(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("A2", "S2", sql="SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def collect_join_turns(spark, d):
    rows = table(spark, d, "conversations").where("conv_id IS NOT NULL")
    return R.joined_per_group(rows, ["conv_id"], "text", ["turn"])


@query("P5", "P6", "S11", sql="SELECT event_id, value FROM events ORDER BY event_id LIMIT 1000")
def capped_rows(spark, d):
    return R.capped(table(spark, d, "events").select("event_id", "value"), ["event_id"], 1000)


@query("P7", sql=f"SELECT event_id FROM events WHERE substr({_H.format('event_id')}, 1, 8) < '33333333'")
def hash_sample(spark, d):
    return R.hash_sample(table(spark, d, "events").select("event_id"), F.col("event_id"), 0.2)


@query("P8", sql=f"SELECT event_id FROM events ORDER BY {_H.format('event_id')} LIMIT 100")
def reservoir_hash_topk(spark, d):
    return R.reservoir(table(spark, d, "events").select("event_id"), F.col("event_id"), 100)


@query("P8", sql="""
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, ('0x' || substr(md5(concat_ws('|', event_id, '42')), 1, 8))::BIGINT AS h FROM events),
s AS (SELECT *, CASE WHEN n < 100 THEN row_number() OVER (PARTITION BY n < 100 ORDER BY h, n) - 1 ELSE h % (n + 1) END AS slot FROM n)
SELECT slot::BIGINT AS slot, arg_max(event_id, n) AS event_id FROM s WHERE slot < 100 GROUP BY slot""")
def reservoir_replace(spark, d):
    return R.replacing_sample(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], F.col("event_id"), 100).select("slot", "event_id")


@query("P9", "W9", sql="SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 256 AS batch_id FROM events")
def batch_ids(spark, d):
    return R.batch_ids(table(spark, d, "events").select("event_id"), ["event_id"], 256)


@query("S1", "K11", sql="SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS snapshot FROM orders ORDER BY snapshot DESC LIMIT 3")
def snapshot_retention(spark, d):
    return R.newest(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("snapshot")), "snapshot", 3)


@query("S1", sql="""
SELECT o_orderkey, o_custkey FROM orders WHERE strftime(o_orderdate, '%Y%m%d') = (SELECT max(strftime(o_orderdate, '%Y%m%d')) FROM orders)""")
def latest_snapshot(spark, d):
    rows = table(spark, d, "orders").withColumn("snapshot", F.date_format("o_orderdate", "yyyyMMdd"))
    return rows.join(F.broadcast(rows.agg(F.max("snapshot").alias("snapshot"))), "snapshot").select("o_orderkey", "o_custkey")


@query("S12", "A10", sql="""
SELECT l_returnflag, round(sum(s * w) / sum(w), 6) AS score FROM (
  SELECT l_returnflag, (l_quantity + l_discount + l_tax) / 3 AS s, l_extendedprice AS w FROM lineitem) GROUP BY l_returnflag""")
def weighted_mean_score(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", ((F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")) / 3).alias("s"), F.col("l_extendedprice").alias("w")
    )
    return rows.groupBy("l_returnflag").agg(F.round(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")), 6).alias("score"))


@query("S13", "F12", sql="""
SELECT event_type, sum((props ->> 'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT (props ->> 'k')::BIGINT) AS k_distinct FROM events GROUP BY event_type""")
def json_props(spark, d):
    k = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k")
    rows = table(spark, d, "events").select("event_type", k)
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count_distinct("k").alias("k_distinct"))


@query("S15", "S16", sql="""
SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source""")
def file_stats(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))


@query("S20", sql="""
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT e AS epoch, source FROM range(50) t(e) JOIN s ON e % n = k""")
def file_by_epoch(spark, d):
    return R.choice_by_epoch(table(spark, d, "documents"), "source", 50)


@query("S15", "W8", sql="SELECT n_nationkey, e AS epoch FROM nation, (SELECT unnest([0, 1, 2])::INTEGER AS e)")
def epoch_cycle(spark, d):
    return R.epochs(table(spark, d, "nation").select("n_nationkey"), 3)


@query("S14", "S18", sql="""
SELECT split, count(*) AS n FROM (SELECT CASE WHEN h < '1999999a' THEN 'test' WHEN h < '33333334' THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT substr(md5(concat_ws('|', doc_id, '42')), 1, 8) AS h FROM documents)) GROUP BY split""")
def split_union(spark, d):
    rows = table(spark, d, "documents").select(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("42"))), 1, 8).alias("h"))
    bounds = (("test", "0", "1999999a"), ("validation", "1999999a", "33333334"), ("train", "33333334", "g"))
    parts = [rows.where((F.col("h") >= low) & (F.col("h") < high)).select(F.lit(name).alias("split")) for name, low, high in bounds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


@query("S9", "S10", "A5", sql="""
SELECT doc_id, list_sort(list_distinct(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, lang], lambda x: x IS NOT NULL))) AS labels
FROM documents JOIN labels USING (doc_id)""")
def aspect_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    marks = F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang"))
    return rows.select("doc_id", F.sort_array(F.array_distinct(F.array_compact(marks))).alias("labels"))


@query("S22", sql="""
WITH v AS (SELECT event_type AS word, min(event_id) AS first FROM events GROUP BY event_type)
SELECT word, coalesce(list_sum(embedding::DOUBLE[]), 0.0) IS NOT NULL AS found, round(coalesce(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 0), 6) AS power
FROM v LEFT JOIN embeddings ON vec_id = first * 400""")
def embedding_lookup(spark, d):
    vocabulary = table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first")).withColumnRenamed("event_type", "word")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = vocabulary.join(vectors, F.col("vec_id") == F.col("first") * 400, "left")
    vector = F.coalesce("v", F.array_repeat(F.lit(0.0), 64))
    power = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("word", vector.isNotNull().alias("found"), F.round(power, 6).alias("power"))


@query("J2", "J3", sql="""
SELECT e.event_type, c.c_mktsegment, count(*) AS n FROM events e JOIN customer c ON e.user_id = c.c_custkey GROUP BY ALL
UNION ALL SELECT event_type, NULL, count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY event_type""")
def id_lookup(spark, d):
    events, customers = table(spark, d, "events").select("event_type", "user_id"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    found = events.join(customers, "user_id").groupBy("event_type", "c_mktsegment").agg(F.count("*").alias("n"))
    unknown = events.where("user_id IS NOT NULL").join(customers, "user_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))
    return found.unionByName(unknown.withColumn("c_mktsegment", F.lit(None).cast("string")))


@query("W8", "B9", sql="""
WITH t AS (SELECT lang AS task, count(*) // 16 AS batches FROM documents GROUP BY lang),
b AS (SELECT task, unnest(range(batches)) AS batch FROM t)
SELECT task, batch::INTEGER AS batch, row_number() OVER (ORDER BY md5(concat_ws('|', task, batch, '42')), task, batch) - 1 AS position FROM b""")
def task_interleave(spark, d):
    tasks = table(spark, d, "documents").groupBy(F.col("lang").alias("task")).agg(F.floor(F.count("*") / 16).alias("batches"))
    return R.interleaved(tasks, "task", "batches")


@query("B9", sql="SELECT source, ceil(count(*) / (2 * 8 * 4))::BIGINT AS steps FROM documents GROUP BY source")
def fetch_batches(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.ceil(F.count("*") / (2 * 8 * 4)).alias("steps"))
