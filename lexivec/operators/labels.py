"""Label vocabularies and the conversion of labels to model columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.functions import vectors as V
from lexivec.operators.metrics import IGNORED
from lexivec.operators.relational import require_columns

OUTSIDE = "O"


def label_ids(labels: DataFrame) -> DataFrame:
    """Distinct labels in order with dense ids (a label set is small: one row per class)."""
    distinct = labels.select(F.col(labels.columns[0]).alias("label")).where("label IS NOT NULL").distinct()
    return distinct.withColumn("id", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def bio_label_ids(labels: DataFrame, already_bio: bool = False) -> DataFrame:
    """``B-`` and ``I-`` of every label (or the labels as they are) and the outside label."""
    rows = labels.select(F.col(labels.columns[0]).alias("l")).where("l IS NOT NULL").distinct()
    both = F.col("l") if already_bio else F.explode(F.array(F.concat(F.lit("B-"), "l"), F.concat(F.lit("I-"), "l")))
    outside = labels.sparkSession.createDataFrame([(OUTSIDE,)], "label string")
    return label_ids(rows.select(both.alias("label")).unionByName(outside))


def with_label_ids(rows: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``label_id``; a label that has no id fails the job.  Spark broadcasts the ids if they are few."""
    joined = rows.join(ids.select(F.col("label").alias(label), F.col("id").alias("label_id")), label, "left")
    return joined.withColumn("label_id", F.when(F.col("label_id").isNull() & F.col(label).isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), label))).otherwise(F.col("label_id")))


def multi_hot_labels(rows: DataFrame, keys: Sequence[str], label: str, ids: DataFrame, size: int) -> DataFrame:
    """A 1.0/0.0 vector per group of labels."""
    places = with_label_ids(rows, label, ids).groupBy(*keys).agg(F.collect_set("label_id").alias("ids"))
    return places.select(*keys, V.multi_hot(F.col("ids"), size).alias("hot"))


def aligned_labels(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``pos``, ``label``: B- on the first token that a span overlaps, I- on the others, else outside.
    ``tokens``: ``pos``, ``start``, ``stop``; ``spans``: ``type``, ``first``, ``last`` offsets (end exclusive)."""
    t = tokens.select(*keys, "pos", "start", "stop")
    s = spans.select(*keys, "type", "first", "last")
    hit = t.join(s, [*keys]).where("start < last AND stop > first").groupBy(*keys, "pos").agg(F.min(F.struct("first", "last", "type")).alias("s"))
    marked = t.join(hit, [*keys, "pos"], "left")
    begins = F.lag(F.col("s.first")).over(Window.partitionBy(*keys).orderBy("pos"))
    prefix = F.when(begins == F.col("s.first"), "I-").otherwise("B-")
    return marked.select(*keys, "pos", F.when(F.col("s").isNull(), OUTSIDE).otherwise(F.concat(prefix, F.col("s.type"))).alias("label"))


def masked_label_ids(label_id: Column, special: Column) -> Column:
    """Special tokens carry no label; the first word does."""
    return F.when(special, IGNORED).otherwise(label_id)


def next_pairs(rows: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Each text with the one that follows it."""
    following = F.lead(text).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("next_text", following).where("next_text IS NOT NULL")


def cloze_batches(pairs: DataFrame, order: Column, size: int) -> DataFrame:
    """Questions with contexts in batches; the positive label is the row's place in its batch."""
    from lexivec.operators.relational import dense_ids

    return dense_ids(pairs, [order], "_n").withColumn("batch", F.floor(F.col("_n") / size)).withColumn("positive", F.col("_n") % size).drop("_n")


def span_offset_rows(rows: DataFrame, keys: Sequence[str], text: str, span: str, names: Sequence[str], max_length: int) -> DataFrame:
    """``keys``, ``tokens`` (marked, cut and padded to ``max_length``), and the two parts of ``span`` under ``names``, as they
    were given: no position is moved where tokens are cut.  Null texts have no tokens, null spans null ends."""
    words = F.slice(F.coalesce(X.words(F.col(text)), F.array().cast("array<string>")), 1, max_length - 2)
    tokens = F.concat(F.array(F.lit("[CLS]")), words, F.array(F.lit("[SEP]")))
    padded = F.concat(tokens, F.array_repeat(F.lit("[PAD]"), F.lit(max_length) - F.size(tokens)))
    return rows.select(*keys, padded.alias("tokens"), F.get(span, F.lit(0)).alias(names[0]), F.get(span, F.lit(1)).alias(names[1]))


def label_map(ids: DataFrame, most: int = 2_000) -> Column:
    """Label to id as a literal map.  A label set holds one row per class; one with over ``most`` raises."""
    rows = ids.select("label", F.col("id").cast("long")).take(most + 1)
    if len(rows) > most:
        raise ValueError(f"over {most} labels: use with_label_ids")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return F.create_map(*[F.lit(x) for row in rows for x in row]) if rows else empty


def _known(ids: Column, label: Column) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unknown label "), label)).cast("long")
    return F.when(label.isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(F.try_element_at(ids, label), unknown))


def token_label_ids(word_ids: Column, labels: Column, ids: Column) -> Column:
    """The id of its word's label for every token; tokens of no word (null) are IGNORED, those of the first word are not."""
    of_word = F.transform(labels, lambda label: _known(ids, label))
    return F.transform(word_ids, lambda w: F.when(w.isNull(), F.lit(IGNORED).cast("long")).otherwise(F.get(of_word, w)))


REQUIRED = {
    "sequence_classification": ("text", "label"),
    "multi_label_classification": ("text", "labels"),
    "token_classification": ("word_ids", "labels"),
    "embeds_seq2seq": ("inputs_embeds", "decoder_inputs_embeds"),
    "embeds_regression": ("inputs_embeds", "decoder_inputs_embeds", "labels"),
    "span_offsets": ("start_position", "end_position"),
    "next_token": ("text", "next_text"),
    "inverse_cloze": ("question", "context", "has_answer"),
}


def convert(rows: DataFrame, task_type: str, ids: DataFrame | None = None) -> DataFrame:
    """The columns that a task's model takes; unknown tasks and missing columns raise.  Tasks whose labels are
    classes need ``ids`` (``label_ids``); a label that it lacks fails the job, a null label stays null."""
    if task_type not in REQUIRED:
        raise ValueError(f"no converter for task type {task_type!r}")
    require_columns(rows, *REQUIRED[task_type])
    if task_type.endswith("_classification"):
        if ids is None:
            raise ValueError(f"{task_type} needs label ids")
        known = label_map(ids)
        if task_type == "token_classification":
            return rows.select("word_ids", token_label_ids(F.col("word_ids"), F.col("labels"), known).alias("labels"))
        if task_type == "multi_label_classification":
            return rows.select("text", V.multi_hot(F.transform("labels", lambda label: _known(known, label)), ids.count()).alias("labels"))
        return rows.select("text", _known(known, F.col("label")).alias("labels"))
    if task_type == "inverse_cloze":
        return rows.where("has_answer").select("question", "context")
    return rows.select(*REQUIRED[task_type])
