"""Streams (an extension: the batch operators' stages on unbounded input)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexivec.operators.model import EncoderSpec, encode
from lexivec.operators.relational import require_columns


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by key and window; rows later than the watermark are left out and old state goes."""
    at = F.window(F.col(time), width, slide or width)
    rows = events.withWatermark(time, late).groupBy(at.alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows whose keys have not come before within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def encode_stream(rows: DataFrame, id_field: str, content: str, spec: EncoderSpec, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Encode a text stream into a vector table; the checkpoint makes batches write exactly once."""
    require_columns(rows, id_field, content)
    vectors = rows.select(id_field, encode(content, spec).alias(content))
    writer = vectors.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
