"""Scans: snapshots, JSON lines of the task formats, line files, vector tables.

Every reader returns a lazy DataFrame with a declared schema; nothing is collected.  Paths are Hadoop paths.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from lexivec.operators.relational import capped, first_per_group, select_fields

SNAPSHOT = re.compile(r"\d{8}_\d{6}_\d{6}$")
SPLITS = {"train": "train", "dev": "validation", "test": "test"}
TOKEN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pos", T.StringType()), T.StructField("surface", T.StringType())])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``length`` of the files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def entries(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files and folders right in a folder, in order (a directory listing)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(path))


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The snapshot names in a folder, oldest first."""
    return [name for name in entries(spark, folder) if SNAPSHOT.match(name)]


def latest_snapshot(spark: SparkSession, folder: str) -> str:
    names = snapshots(spark, folder)
    if not names:
        raise FileNotFoundError(f"no snapshot in {folder}")
    return f"{folder.rstrip('/')}/{names[-1]}"


@dataclass(frozen=True)
class FetchSpec:
    """What to fetch: the newest snapshot of a folder or a given path."""

    folder: str | None = None
    path: str | None = None
    format: str = "json"
    schema: T.StructType | None = None
    group_by_fields: Sequence[str] = ()
    group_select_field: str | None = None
    order_fields: Sequence[str] = ()
    select_fields: Sequence[str] = ()
    max_records: int | None = None


def fetch(spark: SparkSession, spec: FetchSpec) -> DataFrame:
    """One lazy plan: scan, one row per group, projection, cap.  Grouping needs both of its settings."""
    if spec.format not in ("json", "parquet"):
        raise ValueError(f"format {spec.format!r} is neither json nor parquet")
    reader = spark.read.schema(spec.schema) if spec.schema else spark.read
    df = reader.format(spec.format).load(spec.path or latest_snapshot(spark, spec.folder))
    if spec.group_by_fields and spec.group_select_field:
        df = first_per_group(df, spec.group_by_fields, spec.group_select_field, spec.order_fields or [spec.group_select_field])
    df = select_fields(df, spec.select_fields)
    return capped(df, spec.order_fields or df.columns[:1], spec.max_records) if spec.max_records is not None else df


def splits(spark: SparkSession, folder: str, read) -> DataFrame:
    """``read(spark, path)`` of the train, dev and test files (or folders of files) that there are, with their ``split``."""
    present = {name.removesuffix(".jsonl") for name in entries(spark, folder)}
    parts = [read(spark, f"{folder.rstrip('/')}/{name}.jsonl").withColumn("split", F.lit(split)) for name, split in SPLITS.items() if name in present]
    if not parts:
        raise FileNotFoundError(f"no train, dev or test file in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ner_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text``, ``tokens``, ``ner_starts``, ``ner_ends``, ``ner_tags``, ``single``: tokens that begin with white space are
    left out; documents of one token are marked."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("labels", T.ArrayType(SPAN))])
    rows = spark.read.schema(schema).json(path)
    kept = F.filter("tokens", lambda t: ~t["surface"].rlike(r"^\s"))
    surfaces = F.transform(kept, lambda t: t["surface"])
    pick = lambda name: F.transform("labels", lambda s: s[name])
    return rows.select("text", surfaces.alias("tokens"), pick("start").alias("ner_starts"), pick("end").alias("ner_ends"), pick("label").alias("ner_tags"), (F.size(kept) <= 1).alias("single"))


def bio_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and ``spans``: BIO labels with offsets are merged to spans; a last span of one token counts."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(SPAN))])
    rows = spark.read.schema(schema).json(path)
    start = F.array().cast(T.ArrayType(SPAN))

    def step(done, x):
        kind, name = F.substring(x["label"], 1, 1), F.substring(x["label"], 3, 1000)
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"), last["label"].alias("label")).cast(SPAN)))
        opened = F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), name.alias("label")).cast(SPAN)))
        return F.when((kind == "I") & (F.size(done) > 0) & (last["label"] == name), joined).when(kind == "B", opened).otherwise(done)

    return rows.select("text", F.aggregate("labels", start, step).alias("spans"))


def qa_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, query string, start_position int, end_position int"
    return spark.read.schema(schema).json(path)


def cloze_lines(spark: SparkSession, path: str) -> DataFrame:
    """Answered questions; lines that aren't JSON are skipped."""
    schema = "question string, answers array<string>, context string, has_answer boolean"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("has_answer")


def aspect_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text`` and the distinct first elements of ``annotation``; lines that aren't JSON are skipped."""
    rows = spark.read.schema("text string, annotation array<array<string>>").option("mode", "DROPMALFORMED").json(path)
    return rows.select("text", F.array_distinct(F.transform("annotation", lambda a: F.get(a, F.lit(0)))).alias("labels"))


def recommendation_vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("sid").alias("recommendation_sid"), "item_id", F.col("text_vector").alias("inputs_embeds"), F.col("next_text_vector").alias("decoder_inputs_embeds"), F.col("next_text").alias("item_description"))


def feedback_vectors(rows: DataFrame) -> DataFrame:
    """The label is the mean of the three scores."""
    label = (F.col("interaction") + F.col("passion") + F.col("promise")) / 3
    return rows.select(F.col("sid").alias("recommendation_sid"), "item_id", F.col("text_vector").alias("inputs_embeds"), F.col("next_text_vector").alias("decoder_inputs_embeds"), label.cast("float").alias("labels"))


def query_descriptions(rows: DataFrame) -> DataFrame:
    """``recommendation_sid``, ``text``, ``next_text``, ``evaluation``: token JSON becomes text."""
    tokens = F.from_json("reco_request_tokens", T.ArrayType(TOKEN))
    surface = F.array_join(F.transform(tokens, lambda t: t["surface"]), " ")
    score = (F.col("interaction") + F.col("passion") + F.col("promise")) / 3
    return rows.select(F.col("sid").alias("recommendation_sid"), F.concat_ws(" ", surface, "text").alias("text"), "next_text", score.cast("float").alias("evaluation"))


def grouped_tokens(rows: DataFrame, keys: Sequence[str], tokens: str, order: str) -> DataFrame:
    """Per group the surfaces of its token JSON, a line per row; rows without an id are left out."""
    surface = F.array_join(F.transform(F.from_json(tokens, T.ArrayType(TOKEN)), lambda t: t["surface"]), " ")
    lines = rows.where(F.col(keys[0]).isNotNull()).select(*keys, order, surface.alias("_s"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_s"))), lambda r: r["_s"]), "\n").alias("text"))


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(paths).withColumnRenamed("value", "line")


def file_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """``files``, ``bytes``, ``lines`` of a folder of text files."""
    sizes = listing(spark, folder).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    count = spark.read.option("recursiveFileLookup", "true").text(folder).agg(F.count("*").alias("lines"))
    return sizes.crossJoin(count)  # one row each


def corpus_articles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``doc``, ``line`` of a corpus JSON file: paragraphs of news, sentences of the other kinds, joined to a line."""
    from lexivec.functions.text import SENTENCE_MARK

    field = {"news": "paragraph", "ne": "sentence", "mp": "sentence", "dp": "sentence"}.get(kind)
    if field is None:
        raise ValueError(f"no corpus type {kind!r}")
    part = T.ArrayType(T.StructType([T.StructField("form", T.StringType())]))
    schema = T.StructType([T.StructField("document", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField(field, part)])))])
    docs = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("document").alias("d"))
    forms = F.filter(F.transform(F.col(f"d.{field}"), lambda s: F.btrim(s["form"])), lambda s: F.length(s) > 1)
    return docs.select(F.col("d.id").alias("doc"), F.array_join(forms, SENTENCE_MARK).alias("line")).where(F.length("line") > 1)


def vector_table(spark: SparkSession, path: str, id_column: str, vector: str) -> DataFrame:
    """Identified vectors; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col(id_column) != "").select(id_column, vector)


def with_word_vectors(vocabulary: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``word``, ``idx``, ``vector``: zeros where no vector is known."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return vocabulary.join(vectors.select("word", "vector"), "word", "left").select("word", "idx", F.coalesce("vector", zeros).alias("vector"))




def saved_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all splits of a dataset folder with their ``split``: ``dataset_dict.json`` names the splits, ``state.json``
    of each names its files of Arrow streams.  Other files there are not read.  A task holds one file (writers cut them,
    at 500 MB as a rule).  A folder without ``dataset_dict.json`` is one split, ``train``."""
    folder = folder.rstrip("/")
    names = entries(spark, folder)
    splits = [("train", folder)]
    if "dataset_dict.json" in names:
        splits = [(s, f"{folder}/{s}") for s in _settings(spark, f"{folder}/dataset_dict.json")["splits"]]
    parts = []
    for split, place in splits:
        files = [f"{place}/{f['filename']}" for f in _settings(spark, f"{place}/state.json")["_data_files"]]
        if files:
            parts.append(_arrow_streams(spark, files).withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"no data files in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _arrow_streams(spark: SparkSession, files: list[str]) -> DataFrame:
    def head(batches):
        for batch in batches:
            for content in batch.column(0):
                schema = pa.ipc.open_stream(pa.py_buffer(content.as_py())).schema
                yield pa.RecordBatch.from_pydict({"schema": [schema.remove_metadata().serialize().to_pybytes()]})

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                for part in pa.ipc.open_stream(content.as_buffer()):
                    yield part

    contents = lambda paths: spark.read.format("binaryFile").load(paths).select("content")
    found = contents(files[:1]).mapInArrow(head, "schema binary").first()[0]
    return contents(files).mapInArrow(rows, from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(found)))))
