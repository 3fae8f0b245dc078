"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local folders of sessions without a shared one, by application: for tests on one machine.
_local: dict[str, str] = {}
#: Paths handed out, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where none is configured and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        found = _local.setdefault(application, _local.get(application) or tempfile.mkdtemp(prefix="colloquy-shared-"))
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, as Spark would resolve it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, kind: str = "colloquy") -> str:
    """A new path in the shared folder, which ``clear_scratch`` removes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Remove all tables that this application's jobs wrote to cut their lineage; returns how many.

    For the end of a run, when its results are written: tables made from them can't be read any more.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
