"""Writing rows so that a rerun or a lost executor does no harm."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines in UTF-8; nulls are kept so that all rows have the same keys."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_encoded(train: DataFrame, val: DataFrame | None, path: str) -> None:
    """An encoded data set: one folder for each part."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    if val is not None:
        val.write.mode("overwrite").parquet(f"{path}/val")


def write_shards(df: DataFrame, path: str, rows: int, key: str) -> None:
    """Files of at most so many rows, ranged by key, so that a lookup opens few of them."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """Rows by key: a filter that reaches the file statistics."""
    return spark.read.parquet(path).where(F.col(key).isin(values))


def write_batches(df: DataFrame, path: str, batch: str) -> list[int]:
    """Write batch by batch into its own partition; batches that are there already are skipped.

    Each batch is one overwrite of one partition, so a run that broke off goes on where it was.
    Gives the batches that were written.
    """
    spark, todo = df.sparkSession, df
    if exists(spark, path):
        todo = df.join(spark.read.parquet(path).select(F.col(batch).cast(df.schema[batch].dataType)).distinct(), batch, "left_anti")
    new = sorted(r[0] for r in todo.select(batch).distinct().collect())  # one name for each batch that is written
    if new:
        todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
    return new


def state_json(batches: list[int]) -> str:
    """The resume mark of a sampling run."""
    return json.dumps({"done": sorted(batches), "next": max(batches, default=-1) + 1})
