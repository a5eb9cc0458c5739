"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}  # paths by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.  Only where that is
    unset and the master is local (tests on one machine) a folder of our own is chosen."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexivec-")
    if ":" not in named.split("/")[0]:  # a path of the default file system
        path = context._jvm.org.apache.hadoop.fs.Path(named)
        named = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if named.startswith("file:/") and not named.startswith("file://"):
        named = "file://" + named.removeprefix("file:")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder (compressed, and read by column)."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned_up(spark: SparkSession) -> int:
    """Delete the tables that this session's jobs have written to the shared folder, once their results are no
    longer read; returns how many there were.  (Checkpoints go with ``spark.cleaner.referenceTracking.cleanCheckpoints``.)"""
    context = spark.sparkContext
    for path in _WRITTEN.get(context.applicationId, ()):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(_WRITTEN.pop(context.applicationId, ()))
