"""Queries through readers and sinks: a table goes out in a file format, and what the reader gives back is the result.

Files go to the session's shared folder; ``storage.cleaned_up`` deletes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators.model import EncoderSpec
from lexivec.plans.registry import query, table
from lexivec.sources import readers, sinks
from lexivec.sources.storage import fresh_path

_WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_TALK = f"w AS (SELECT conv_id, turn, role, text, {_WORDS} AS t FROM conversations)"
FILE_DOCS = 64  # documents in one corpus file


def _talk(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", X.words(F.col("text")).alias("t"))


def _token(surface, start):
    return F.struct(start.cast("int").alias("start"), (start + 1).cast("int").alias("end"), F.lit("N").alias("pos"), surface.alias("surface"))


def _json_lines(spark, rows: DataFrame, broken=None) -> str:
    """Rows as JSON lines; those that ``broken`` marks are no JSON."""
    path = fresh_path(spark, "lines")
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != "_broken"]))
    rows.select((F.when(broken, F.concat(F.lit("{broken "), whole)).otherwise(whole) if broken is not None else whole).alias("value")).write.text(path)
    return path


@query("S1", "P1", "K11", sql="SELECT event_id, event_type, 3 AS kept FROM events")
def scan_snapshots(spark, d):
    folder, events = fresh_path(spark, "snapshots"), table(spark, d, "events")
    for day in ("20240101", "20240102", "20240103"):
        events.select((-F.col("event_id") - 1).alias("event_id"), F.lit(day).alias("event_type")).write.json(f"{folder}/{day}_000000_000000")
    events.write.json(f"{folder}/20240104_000000_000000")
    sinks.retain_snapshots(spark, folder, 3)
    spec = readers.FetchSpec(folder=folder, schema=events.schema, select_fields=["event_id", "event_type"])
    return readers.fetch(spark, spec).withColumn("kept", F.lit(len(readers.snapshots(spark, folder))))


@query("S1", "A1", "P5", sql="SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY user_id LIMIT 100")
def scan_groups(spark, d):
    path, events = fresh_path(spark, "table"), table(spark, d, "events")
    events.write.parquet(path)
    spec = readers.FetchSpec(path=path, format="parquet", group_by_fields=["user_id"], group_select_field="event_type", order_fields=["event_id"])
    grouped = readers.fetch(spark, spec)
    again = fresh_path(spark, "table")
    grouped.write.parquet(again)
    return readers.fetch(spark, readers.FetchSpec(path=again, format="parquet", order_fields=["user_id"], max_records=100))


@query("S2", "A2", "F12", sql=f"WITH {_TALK} SELECT conv_id, md5(string_agg(array_to_string(t, ' '), chr(10) ORDER BY turn)) AS text FROM w WHERE conv_id IS NOT NULL GROUP BY conv_id")
def scan_grouped_tokens(spark, d):
    rows = _talk(spark, d).select("conv_id", "turn", F.to_json(F.transform("t", _token)).alias("tokens"))
    path = _json_lines(spark, rows)
    back = spark.read.schema("conv_id long, turn long, tokens string").json(path)
    return readers.grouped_tokens(back, ["conv_id"], "tokens", "turn").select("conv_id", F.md5("text").alias("text"))


@query("S5", sql=f"""
WITH {_TALK}, k AS (SELECT text, t, list_filter(range(len(t)), lambda i: length(t[i + 1]) > 6) AS i FROM w)
SELECT md5(text) AS text, md5(array_to_string(t, ' ')) AS tokens, array_to_string(i, ',') AS starts, array_to_string(list_transform(i, lambda x: x + 1), ',') AS ends,
  array_to_string(list_transform(i, lambda x: 'L' || (length(t[x + 1]) % 3)), ',') AS tags, len(t) <= 1 AS single FROM k""")
def scan_ner_lines(spark, d):
    tokens = F.flatten(F.transform("t", lambda w, i: F.array(_token(w, i), _token(F.lit(" "), i))))
    span = lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.when(F.length(w) > 6, F.concat(F.lit("L"), (F.length(w) % 3).cast("string"))).alias("label"))
    labels = F.filter(F.transform("t", span), lambda s: s["label"].isNotNull())
    out = readers.ner_lines(spark, _json_lines(spark, _talk(spark, d).select("text", tokens.alias("tokens"), labels.alias("labels"))))
    joined = [F.array_join(c, ",").alias(n) for c, n in (("ner_starts", "starts"), ("ner_ends", "ends"), ("ner_tags", "tags"))]
    return out.select(F.md5("text").alias("text"), F.md5(F.array_join("tokens", " ")).alias("tokens"), *joined, "single")


@query("S6", "E7", sql=f"""
WITH {_TALK}, p AS (SELECT conv_id, turn, text, unnest(range(len(t))) AS i, unnest(list_transform(t, lambda x: length(x) % 4)) AS k FROM w),
g AS (SELECT *, sum((k % 2 = 0)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS g FROM p),
s AS (SELECT conv_id, turn, min(i) AS first, arg_min(k, i) // 2 AS kind, g FROM g WHERE g > 0 GROUP BY ALL),
e AS (SELECT s.conv_id, s.turn, s.g, first, s.kind, max(i) + 1 AS last FROM s JOIN g ON s.conv_id = g.conv_id AND s.turn = g.turn AND s.g = g.g AND g.k // 2 = s.kind GROUP BY ALL)
SELECT md5(text) AS text, coalesce(string_agg(first || ':' || last || ':' || CASE kind WHEN 0 THEN 'X' ELSE 'Y' END, ',' ORDER BY first), '') AS spans
FROM conversations LEFT JOIN e USING (conv_id, turn) GROUP BY conv_id, turn, text""")
def scan_bio_lines(spark, d):
    tag = F.array(*[F.lit(x) for x in ("B-X", "I-X", "B-Y", "I-Y")])
    labels = F.transform("t", lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.get(tag, F.length(w) % 4).alias("label")))
    out = readers.bio_lines(spark, _json_lines(spark, _talk(spark, d).select("text", labels.alias("labels"))))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"]))
    return out.select(F.md5("text").alias("text"), F.array_join(spans, ",").alias("spans"))


@query("S7", "S14", "S18", sql="""
SELECT conv_id || '-' || turn AS id, md5(text) AS query, instr(text, ' ')::INTEGER AS start_position, length(text)::INTEGER AS end_position,
  CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM conversations""")
def scan_splits(spark, d):
    folder = fresh_path(spark, "splits")
    rows = _talk(spark, d).select(
        "conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("query"), F.instr("text", " ").alias("start_position"), F.length("text").alias("end_position")
    )
    for name, part in (("test", "= 0"), ("dev", "= 1"), ("train", "> 1")):
        rows.where(f"conv_id % 10 {part}").drop("conv_id").write.json(f"{folder}/{name}.jsonl")
    return readers.splits(spark, folder, readers.qa_lines).withColumn("query", F.md5("query"))


@query("S8", "P4", sql=f"WITH {_TALK} SELECT md5(text) AS question, md5(role) AS context, len(t) AS answers FROM w WHERE role = 'assistant' AND turn % 3 <> 0")
def scan_cloze_lines(spark, d):
    rows = _talk(spark, d)
    body = rows.select(F.col("text").alias("question"), F.col("t").alias("answers"), F.col("role").alias("context"), (F.col("role") == "assistant").alias("has_answer"), (F.col("turn") % 3 == 0).alias("_broken"))
    out = readers.cloze_lines(spark, _json_lines(spark, body, F.col("_broken")))
    return out.select(F.md5("question").alias("question"), F.md5("context").alias("context"), F.size("answers").cast("long").alias("answers"))


@query("S9", "S10", "A5", sql="""
SELECT md5(text) AS text, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS labels FROM documents WHERE doc_id % 5 <> 0""")
def scan_aspect_lines(spark, d):
    pairs = F.array(F.array("lang", "source"), F.array("source", "lang"), F.array("lang", F.lit("x")))
    rows = table(spark, d, "documents").select("text", pairs.alias("annotation"), (F.col("doc_id") % 5 == 0).alias("_broken"))
    out = readers.aspect_lines(spark, _json_lines(spark, rows, F.col("_broken")))
    return out.select(F.md5("text").alias("text"), F.array_join("labels", ",").alias("labels"))


@query("S11", "S12", sql="""
SELECT 's' || vec_id AS sid, 'i' || (vec_id % 9) AS item_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, ((label + vec_id % 7 + vec_id % 4) / 3)::FLOAT::DOUBLE AS labels, 't' || label AS item_description FROM embeddings""")
def scan_feedback_vectors(spark, d):
    v, path = F.col("vec_id"), fresh_path(spark, "table")
    rows = table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), v).alias("sid"), F.concat(F.lit("i"), v % 9).alias("item_id"), F.col("embedding").alias("text_vector"), F.reverse("embedding").alias("next_text_vector"),
        F.concat(F.lit("t"), F.col("label")).alias("next_text"), F.col("label").cast("double").alias("interaction"), (v % 7).cast("double").alias("passion"), (v % 4).cast("double").alias("promise"),
    )
    rows.write.parquet(path)
    back = readers.fetch(spark, readers.FetchSpec(path=path, format="parquet"))
    scores = readers.feedback_vectors(back).select("recommendation_sid", "item_id", "inputs_embeds", "labels")
    texts = readers.recommendation_vectors(back).select("recommendation_sid", "decoder_inputs_embeds", "item_description")
    out = scores.join(texts, "recommendation_sid")
    first = lambda c: F.get(c, F.lit(0)).cast("double")
    return out.select(F.col("recommendation_sid").alias("sid"), "item_id", first("inputs_embeds").alias("first"), first("decoder_inputs_embeds").alias("last"), F.col("labels").cast("double").alias("labels"), "item_description")


@query("S13", "F12", sql=f"""
WITH {_TALK} SELECT conv_id || '-' || turn AS sid, md5(array_to_string(t, ' ') || ' ' || text) AS text, md5(role) AS next_text, ((turn + conv_id % 7 + 1) / 3)::FLOAT::DOUBLE AS evaluation FROM w""")
def scan_descriptions(spark, d):
    rows = _talk(spark, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("sid"), F.to_json(F.transform("t", _token)).alias("reco_request_tokens"), "text", F.col("role").alias("next_text"),
        F.col("turn").cast("double").alias("interaction"), (F.col("conv_id") % 7).cast("double").alias("passion"), F.lit(1.0).alias("promise"),
    )
    back = spark.read.schema(rows.schema).json(_json_lines(spark, rows))
    out = readers.query_descriptions(back)
    return out.select(F.col("recommendation_sid").alias("sid"), F.md5("text").alias("text"), F.md5("next_text").alias("next_text"), F.col("evaluation").cast("double").alias("evaluation"))


@query("S15", "K8", sql="SELECT p_name AS line, count(*) AS n FROM (SELECT p_name FROM part UNION ALL SELECT s_name FROM supplier) GROUP BY p_name")
def scan_chained_lines(spark, d):
    paths = [fresh_path(spark, "lines") for _ in range(2)]
    sinks.write_lines(table(spark, d, "part"), "p_name", paths[0])
    sinks.write_lines(table(spark, d, "supplier"), "s_name", paths[1])
    return readers.lines(spark, paths).groupBy("line").agg(F.count("*").alias("n"))


@query("S16", sql="SELECT sum(strlen(text) + 1)::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents")
def scan_file_statistics(spark, d):
    path = fresh_path(spark, "lines")
    sinks.write_lines(table(spark, d, "documents").where("text IS NOT NULL"), "text", path)
    return readers.file_statistics(spark, path).select("bytes", "lines")


@query("S17", sql="""
SELECT conv_id::VARCHAR AS doc, md5(string_agg(trim(text), chr(8232) ORDER BY turn)) AS line FROM conversations WHERE conv_id IS NOT NULL AND length(trim(text)) > 1 GROUP BY conv_id""")
def scan_corpus_articles(spark, d):
    talk = table(spark, d, "conversations").where("conv_id IS NOT NULL")
    forms = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: F.struct(s["text"].alias("form")))
    docs = talk.groupBy("conv_id").agg(forms.alias("paragraph")).select(F.col("conv_id").cast("string").alias("id"), "paragraph", F.floor(F.col("conv_id") / FILE_DOCS).alias("file"))
    files = docs.groupBy("file").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "paragraph")).alias("document"))).alias("value"))
    path = fresh_path(spark, "articles")
    files.write.partitionBy("file").text(path)  # one JSON value a file
    return readers.corpus_articles(spark, path, "news").select("doc", F.md5("line").alias("line"))


@query("S22", sql="""
SELECT 'w' || c_custkey AS word, c_custkey AS idx, coalesce(embedding[1], 0)::DOUBLE AS first, coalesce(embedding[64], 0)::DOUBLE AS last FROM customer LEFT JOIN embeddings ON vec_id = c_custkey""")
def scan_word_vectors(spark, d):
    path = fresh_path(spark, "vocabulary")
    sinks.save_vocabulary(table(spark, d, "customer").select(F.concat(F.lit("w"), "c_custkey").alias("word"), F.col("c_custkey").alias("idx")), path)
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    out = readers.with_word_vectors(spark.read.parquet(path), vectors, 64)
    return out.select("word", "idx", F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(63)).cast("double").alias("last"))


@query("K2", "K3", "S4", "V1", sql=f"""
WITH {_TALK}, x AS (SELECT conv_id, turn, unnest(t) AS w FROM w),
h AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT < 8 THEN 1 ELSE -1 END AS s FROM x),
c AS (SELECT conv_id, turn, b FROM h GROUP BY ALL HAVING sum(s) <> 0), n AS (SELECT conv_id, turn, count(*) AS places FROM c GROUP BY ALL)
SELECT conv_id || '-' || turn AS id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS vid, coalesce(places, 0) AS places FROM conversations LEFT JOIN n USING (conv_id, turn)""")
def sink_vectors(spark, d):
    path = fresh_path(spark, "vectors")
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    sinks.write_vectors(rows, sinks.VectorSpec("id", ["text"], EncoderSpec()), path, ["conv_id", "turn"])
    out = readers.vector_table(spark, f"{path}/vectors", "id", "text").join(spark.read.parquet(f"{path}/did2vid"), "id")
    return out.select("id", "vid", F.size(F.filter("text", lambda x: x != 0)).cast("long").alias("places"))


@query("K6", "V2", sql="""
WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS new FROM events),
r AS (SELECT *, sum(new::INT) OVER (ORDER BY event_id) AS seen FROM s)
SELECT 'vid2did' AS map, user_id::VARCHAR AS id, (seen - 1)::BIGINT AS vid FROM r WHERE new
UNION ALL SELECT 'dupl', user_id::VARCHAR, max(seen)::BIGINT FROM r WHERE NOT new GROUP BY user_id""")
def sink_id_maps(spark, d):
    path = fresh_path(spark, "maps")
    sinks.write_id_maps(table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_id"), "id", ["event_id"], path)
    maps = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("map"), "id", "vid") for name in ("vid2did", "dupl")]
    return maps[0].unionByName(maps[1])


@query("K4", "K5", sql="SELECT 'talk' AS _index, conv_id, turn, md5(text) AS text, 32 AS width FROM conversations")
def sink_search_documents(spark, d):
    docs = sinks.search_documents(table(spark, d, "conversations").select("conv_id", "turn", "text"), "talk", ["text"])
    doc = F.from_json("doc", "_index string, conv_id long, turn long, text string, text_vec array<float>")
    return docs.select(doc.alias("d")).select("d._index", "d.conv_id", "d.turn", F.md5("d.text").alias("text"), F.size("d.text_vec").alias("width"))


@query("K7", sql="SELECT event_type AS task, event_id, (user_id % 3)::BIGINT AS prediction FROM events")
def sink_predictions(spark, d):
    path = fresh_path(spark, "predictions")
    sinks.write_predictions(table(spark, d, "events").select(F.col("event_type").alias("task"), "event_id", (F.col("user_id") % 3).alias("prediction")), path)
    return spark.read.parquet(path).select("task", "event_id", "prediction")


@query("K9", sql="""
SELECT CASE doc_id % 10 WHEN 0 THEN 'test' ELSE 'train' END AS split, (doc_id % 16)::INTEGER AS shard, count(*) AS docs, sum(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')))::BIGINT AS sentences
FROM documents GROUP BY ALL""")
def sink_shards(spark, d):
    path = fresh_path(spark, "shards")
    docs = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), (F.col("doc_id") % 16).cast("int").alias("shard"), F.filter(F.split("text", "\n"), lambda s: s != "").alias("s"), F.col("text").isNotNull().alias("text")
    )
    sinks.write_shards(docs, "s", path)
    lines = spark.read.schema("value string, split string, shard int").text(path, lineSep="\n").groupBy("split", "shard")
    counts = lines.agg(F.count_if(F.col("value") == "").alias("docs"), F.count_if(F.col("value") != "").alias("sentences"), F.lit(False).alias("text"))
    known = docs.groupBy("split", "shard").agg(F.lit(0).alias("docs"), F.lit(0).alias("sentences"), F.max("text").alias("text"))
    both = counts.unionByName(known).groupBy("split", "shard")  # null texts alone have no number of sentences
    return both.agg(F.sum("docs").alias("docs"), F.when(F.max("text"), F.sum("sentences")).alias("sentences"))


@query("K12", "A8", sql="SELECT event_type AS word, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events)")
def sink_vocabulary(spark, d):
    from lexivec.operators.labels import label_ids

    path = fresh_path(spark, "vocabulary")
    ids = label_ids(table(spark, d, "events").select("event_type")).select(F.col("label").alias("word"), F.col("id").alias("idx"))
    for words in (ids.withColumn("idx", F.col("idx") + 100), ids):  # the second replaces the first
        sinks.save_vocabulary(words, path)
    return spark.read.parquet(path)


@query("S18", sql=f"WITH {_TALK} SELECT role AS split, conv_id, turn, md5(text) AS text, len(t) AS words FROM w")
def scan_saved_dataset(spark, d):
    path = fresh_path(spark, "dataset")
    sinks.save_dataset(_talk(spark, d), "role", path)
    return readers.saved_dataset(spark, path).select("split", "conv_id", "turn", F.md5("text").alias("text"), F.size("t").cast("long").alias("words"))
