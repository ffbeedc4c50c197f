"""Folders for intermediates that all executors see; they go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; on a local master without one a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loom-')}"
    made = f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"

    def end() -> None:
        with contextlib.suppress(Exception):  # the session may have been stopped
            remove(spark, made)

    atexit.register(end)
    return made
