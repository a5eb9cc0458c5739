"""Sinks: vector tables, id maps, search documents, shards, predictions, vocabularies, snapshot retention.

Writers check their columns before any job runs.  Tables are Parquet; a failed write leaves no half-written table
behind, as Spark commits a table's files together.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators.model import EncoderSpec, encode
from lexivec.operators.relational import require_columns
from lexivec.operators.vectors import all_vids, duplicate_map, id_map
from lexivec.sources.readers import snapshots


@dataclass(frozen=True)
class VectorSpec:
    id_field: str
    content_fields: Sequence[str]
    encoder: EncoderSpec = EncoderSpec()
    build_id_mapping: bool = True
    duplicates: str = "first"


def encoded(df: DataFrame, spec: VectorSpec) -> DataFrame:
    """Other columns in their order, then the content fields as vectors."""
    require_columns(df, spec.id_field, *spec.content_fields)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in spec.content_fields]
    return df.select(*rest, *[encode(F.col(f"`{c}`"), spec.encoder).alias(c) for c in spec.content_fields])


def write_vectors(df: DataFrame, spec: VectorSpec, path: str, order: Sequence[str] | None = None) -> None:
    """The vector table below ``path`` and, if asked for, its id maps."""
    encoded(df, spec).write.mode("overwrite").parquet(f"{path}/vectors")
    if spec.build_id_mapping:
        write_id_maps(df, spec.id_field, order or [spec.id_field], path, spec.duplicates)


def write_id_maps(df: DataFrame, id_field: str, order: Sequence[str], path: str, duplicates: str = "first") -> None:
    """``did2vid``, ``vid2did`` and, for first-seen numbering, ``dupl``."""
    rows = df.where(F.col(id_field) != "").select(*dict.fromkeys([id_field, *order]))
    id_map(rows, id_field, order, duplicates).write.mode("overwrite").parquet(f"{path}/did2vid")
    if duplicates == "first":
        id_map(rows, id_field, order).select("vid", "id").write.mode("overwrite").parquet(f"{path}/vid2did")
        duplicate_map(rows, id_field, order).write.mode("overwrite").parquet(f"{path}/dupl")
    else:
        all_vids(rows, id_field, order).write.mode("overwrite").parquet(f"{path}/vid2did")


def search_documents(df: DataFrame, index: str, content_fields: Sequence[str], vector_fields: Sequence[str] = (), encoder: EncoderSpec = EncoderSpec()) -> DataFrame:
    """``doc``: the row as JSON with ``_index``; texts stay, and vectors join them under their own names
    (``{field}_vec`` unless named).  Names must pair with fields."""
    names = list(vector_fields) or [f"{c}_vec" for c in content_fields]
    if len(names) != len(content_fields):
        raise ValueError("vector fields and content fields differ in number")
    require_columns(df, *content_fields)
    vectors = [encode(F.col(c), encoder).alias(n) for c, n in zip(content_fields, names, strict=True)]
    return df.select(*df.columns, *vectors, F.lit(index).alias("_index")).select(F.to_json(F.struct("*")).alias("doc"))


def send(documents: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch_size: int = 8) -> None:
    """Post documents in batches from the executors; ``connect`` makes a client's bulk function in each task."""

    def post(rows: Iterator) -> None:
        bulk, batch = connect(), []
        for r in rows:
            batch.append(json.loads(r.doc))
            if len(batch) == batch_size:
                bulk(batch)
                batch = []
        if batch:
            bulk(batch)

    documents.foreachPartition(post)


def write_lines(df: DataFrame, line: str, path: str) -> None:
    df.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_shards(docs: DataFrame, sentences: str, path: str) -> None:
    """Text files by ``split`` and ``shard``: a sentence a line, a blank line after each document (nothing else of one without sentences).
    Lines end with a line feed alone; sentences may hold carriage returns.  Rows stream into their shard's file; no shard is gathered."""
    kept = F.filter(sentences, lambda s: s != "")
    body = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")
    rows = docs.select("split", "shard", body.alias("value")).repartition("split", "shard")
    rows.write.mode("overwrite").partitionBy("split", "shard").text(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    require_columns(rows, "task").write.mode("overwrite").partitionBy("task").parquet(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Written beside the old one, then renamed over it, so that readers always find a whole one."""
    spark = vocabulary.sparkSession
    vocabulary.select("word", "idx").write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old, new, spare = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    store.delete(spare, True)
    if store.exists(old):
        store.rename(old, spare)
    store.rename(new, old)


def retain_snapshots(spark: SparkSession, folder: str, keep: int = 3) -> list[str]:
    """Delete all but the newest snapshots; returns what went."""
    gone = snapshots(spark, folder)[:-keep] if keep else snapshots(spark, folder)
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in gone:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return gone


def distribute(spark: SparkSession, files: Iterable[str]) -> list[str]:
    """Give model and tokenizer files to every executor; the names under which tasks find them."""
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rstrip("/").rsplit("/", 1)[-1] for f in files]


def save_dataset(rows: DataFrame, split: str, folder: str) -> None:
    """A dataset folder that ``readers.saved_dataset`` opens: ``rows`` by the values of ``split`` (few), each task a file of an Arrow
    stream a split.  Names are new for each attempt, and ``state.json`` lists only those of tasks that succeeded."""
    fields = [f for f in rows.schema.fields if f.name != split]

    def write(batches):
        store, root = FileSystem.from_uri(folder)
        out = {}
        for batch in batches:
            plain = batch.select([f.name for f in fields])
            for name in batch.column(split).unique().to_pylist():
                if name not in out:
                    store.create_dir(f"{root}/{name}")
                    file = f"data-{uuid.uuid4().hex}.arrow"
                    stream = store.open_output_stream(f"{root}/{name}/{file}")
                    out[name] = (file, stream, pa.ipc.new_stream(stream, plain.schema))
                out[name][2].write_batch(plain.filter(pc.equal(batch.column(split), name)))
        for _, stream, writer in out.values():
            writer.close()
            stream.close()
        yield pa.RecordBatch.from_pydict({"split": list(out), "file": [f for f, _, _ in out.values()]}, schema=pa.schema([("split", pa.string()), ("file", pa.string())]))

    by_split: dict[str, list[str]] = {}
    for r in rows.where(F.col(split).isNotNull()).mapInArrow(write, "split string, file string").collect():  # a row per file
        by_split.setdefault(r.split, []).append(r.file)
    store, root = FileSystem.from_uri(folder)
    store.create_dir(root)
    for name, files in by_split.items():
        with store.open_output_stream(f"{root}/{name}/state.json") as f:
            f.write(json.dumps({"_data_files": [{"filename": n} for n in sorted(files)], "_split": name}).encode())
    with store.open_output_stream(f"{root}/dataset_dict.json") as f:
        f.write(json.dumps({"splits": sorted(by_split)}).encode())
