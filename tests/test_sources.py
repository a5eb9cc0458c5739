"""Readers, sinks and streams on small files."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.operators.model import EncoderSpec, HashingEncoder
from lexivec.plans import catalog
from lexivec.sources import readers, sinks
from lexivec.streaming import encode as streams


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_snapshots_and_fetch(spark, tmp_path):
    for k, name in enumerate(["20240101_000000_000000", "20240203_101010_000001", "notes"]):
        put(tmp_path / name / "a.json", *[{"id": i, "k": k, "g": i % 2} for i in range(5)])
    assert readers.latest_snapshot(spark, str(tmp_path)).endswith("20240203_101010_000001")
    out = readers.fetch(spark, readers.FetchSpec(folder=str(tmp_path), select_fields=["id"], order_fields=["id"], max_records=3))
    assert [r.id for r in out.collect()] == [0, 1, 2] and out.columns == ["id"]
    grouped = readers.fetch(spark, readers.FetchSpec(folder=str(tmp_path), group_by_fields=["g"], group_select_field="id"))
    assert {(r.g, r.id) for r in grouped.collect()} == {(0, 0), (1, 1)}
    with pytest.raises(ValueError):
        readers.fetch(spark, readers.FetchSpec(path="x", format="csv"))
    assert sinks.retain_snapshots(spark, str(tmp_path), 1) == ["20240101_000000_000000"]
    with pytest.raises(FileNotFoundError):
        readers.latest_snapshot(spark, str(tmp_path / "notes"))


def test_task_lines(spark, tmp_path):
    tok = lambda a, b, s: {"start": a, "end": b, "pos": "N", "surface": s}
    path = put(tmp_path / "ner.jsonl", {"text": "a b", "tokens": [tok(0, 1, "a"), tok(1, 2, " "), tok(2, 3, "b")], "labels": [{"start": 0, "end": 1, "label": "X"}]})
    row = readers.ner_lines(spark, path).first()
    assert row.tokens == ["a", "b"] and row.ner_tags == ["X"] and not row.single
    bio = [{"start": a, "end": b, "label": x} for a, b, x in ((0, 2, "B-X"), (2, 4, "I-X"), (6, 7, "B-Y"))]
    spans = readers.bio_lines(spark, put(tmp_path / "bio.jsonl", {"text": "t", "labels": bio})).first().spans
    assert [(s.start, s.end, s.label) for s in spans] == [(0, 4, "X"), (6, 7, "Y")]
    path = put(tmp_path / "ict.jsonl", {"question": "q", "answers": ["a"], "context": "c", "has_answer": True}, "{broken", {"question": "r", "has_answer": False})
    assert [r.question for r in readers.cloze_lines(spark, path).collect()] == ["q"]
    path = put(tmp_path / "aspect.jsonl", {"text": "t", "annotation": [["x", "1"], ["x", "2"], ["y"]]}, "no json")
    assert [r.labels for r in readers.aspect_lines(spark, path).collect() if r.text] == [["x", "y"]]
    path = put(tmp_path / "qa.jsonl", {"id": "1", "query": "q", "start_position": 1, "end_position": 2})
    assert readers.qa_lines(spark, path).first().end_position == 2


def test_splits(spark, tmp_path):
    for name in ("train", "dev"):
        put(tmp_path / f"{name}.jsonl", {"id": name, "query": "q", "start_position": 0, "end_position": 1})
    out = readers.splits(spark, str(tmp_path), readers.qa_lines)
    assert {(r.id, r.split) for r in out.collect()} == {("train", "train"), ("dev", "validation")}


def test_recommendation_rows(spark):
    tokens = json.dumps([{"start": 0, "end": 1, "pos": "N", "surface": s} for s in ("x", "y")])
    rows = spark.createDataFrame([("s", "i", [1.0], [2.0], "n", 1.0, 2.0, 3.0, tokens, "t")], "sid string, item_id string, text_vector array<float>, next_text_vector array<float>, next_text string, interaction float, passion float, promise float, reco_request_tokens string, text string")
    assert readers.feedback_vectors(rows).first().labels == 2.0
    assert readers.query_descriptions(rows).first().text == "x y t"
    assert readers.recommendation_vectors(rows).first().item_description == "n"
    assert readers.grouped_tokens(rows, ["item_id"], "reco_request_tokens", "sid").first().text == "x y"


def test_files_and_articles(spark, tmp_path):
    put(tmp_path / "t" / "a.txt", "one", "two")
    put(tmp_path / "t" / "b.txt", "three")
    row = readers.file_statistics(spark, str(tmp_path / "t")).first()
    assert (row.files, row.bytes, row.lines) == (2, 12, 3)
    path = put(tmp_path / "news.json", {"document": [{"id": "d", "paragraph": [{"form": " ab "}, {"form": "c"}, {"form": "de"}]}]})
    assert readers.corpus_articles(spark, path, "news").first().line == "ab de"
    with pytest.raises(ValueError):
        readers.corpus_articles(spark, path, "other")


def test_vector_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x y", 1), ("b", "z", 2), ("a", "x", 3), ("", "w", 4)], "id string, text string, n int")
    spec = sinks.VectorSpec("id", ["text"], EncoderSpec(lambda: HashingEncoder(8)))
    sinks.write_vectors(rows, spec, str(tmp_path / "v"), ["n"])
    out = spark.read.parquet(str(tmp_path / "v/vectors"))
    assert out.columns == ["id", "n", "text"] and all(len(r.text) == 8 for r in out.collect())
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"v/{name}")).collect())
    assert read("did2vid") == [("a", 0), ("b", 1)] and read("vid2did") == [(0, "a"), (1, "b")] and read("dupl") == [("a", 2)]
    assert readers.vector_table(spark, str(tmp_path / "v/vectors"), "id", "text").count() == 3
    with pytest.raises(ValueError, match="missing"):
        sinks.write_vectors(rows.drop("text"), spec, str(tmp_path / "w"))


def test_search_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string").coalesce(1)
    docs = sinks.search_documents(rows, "idx", ["text"], encoder=EncoderSpec(lambda: HashingEncoder(4)))
    doc = json.loads(docs.first().doc)
    assert doc["_index"] == "idx" and doc["text"] == "t0" and len(doc["text_vec"]) == 4
    folder = str(tmp_path)

    def connect():
        def bulk(batch):
            with open(f"{folder}/out", "a") as f:
                f.write(f"{len(batch)}\n")

        return bulk

    sinks.send(docs, connect, 4)
    assert (tmp_path / "out").read_text().split() == ["4", "4", "2"]
    with pytest.raises(ValueError):
        sinks.search_documents(rows, "idx", ["text"], ["a", "b"])


def test_shards_of_odd_texts_equal_sql(spark, tmp_path):
    texts = ["a\rb\nc", "x\r\n\r\ny", "\r", "", "\n\n", "end\n", "\n start", None, "p\u2028q\x0bz\u0085w"]
    rows = [(i, t) for i, t in enumerate(texts * 5)] + [(None, "lost\rid"), (-7, "less"), (1000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["sink_shards"](spark, str(tmp_path)).select("split", "shard", "docs", "sentences").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["sink_shards"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shards_predictions_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([(["a", "b"], "train", 0), (["c"], "test", 1)], "s array<string>, split string, shard int")
    sinks.write_shards(docs, "s", str(tmp_path / "s"))
    files = [f for f in (tmp_path / "s/split=train/shard=0").iterdir() if f.name.startswith("part")]
    assert files[0].read_text() == "a\nb\n\n"
    sinks.write_predictions(spark.createDataFrame([("t", 1)], "task string, p int"), str(tmp_path / "p"))
    assert (tmp_path / "p/task=t").is_dir()
    for n in (1, 2):
        sinks.save_vocabulary(spark.createDataFrame([("w", n)], "word string, idx long"), str(tmp_path / "voc"))
    assert spark.read.parquet(str(tmp_path / "voc")).first().idx == 2
    words = readers.with_word_vectors(spark.createDataFrame([("w", 0), ("x", 1)], "word string, idx long"), spark.createDataFrame([("w", [1.0, 2.0])], "word string, vector array<float>"), 2)
    assert {r.word: r.vector for r in words.collect()} == {"w": [1, 2], "x": [0, 0]}


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("k"), F.lit(1.0).alias("v"), F.lit("a b").alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = T.StructType(rows.schema.fields)
    source = streams.read_events(spark, str(tmp_path / "in"), schema)
    q = streams.encode_stream(source, "id", "text", EncoderSpec(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    counts = streams.windowed_counts(source, "ts", "k", "v", "1 hour")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 100


def test_shared_folder_and_clean_up(spark):
    from types import SimpleNamespace

    from lexivec.sources import storage

    table = storage.written(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 5 and os.path.isdir(path)
    assert storage.cleaned_up(spark) >= 1 and not os.path.exists(path)
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        storage.shared_folder(far)


def test_saved_dataset_of_files_by_another_writer(spark, tmp_path):
    import json

    import pyarrow as pa

    schema = pa.schema([("i", pa.int64()), ("text", pa.string()), ("v", pa.list_(pa.float32()))])
    for split, parts in {"train": [[1, 2], [3]], "test": [[]]}.items():
        (tmp_path / split).mkdir()
        for k, ids in enumerate([*parts, [99]]):  # the last file isn't in the list
            with pa.ipc.new_stream(str(tmp_path / split / f"data-{k}.arrow"), schema) as out:
                out.write_table(pa.table({"i": ids, "text": [None if i == 2 else f"t{i}" for i in ids], "v": [[0.5, i] for i in ids]}, schema))
        (tmp_path / split / "state.json").write_text(json.dumps({"_data_files": [{"filename": f"data-{k}.arrow"} for k in range(len(parts))]}))
    (tmp_path / "dataset_dict.json").write_text(json.dumps({"splits": ["train", "test"]}))
    got = sorted((r["i"], r["text"], r["v"], r["split"]) for r in readers.saved_dataset(spark, f"file://{tmp_path}").collect())
    assert got == [(1, "t1", [0.5, 1.0], "train"), (2, None, [0.5, 2.0], "train"), (3, "t3", [0.5, 3.0], "train")]
    assert readers.saved_dataset(spark, f"file://{tmp_path}/train").count() == 3
