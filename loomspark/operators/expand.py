"""Operators that make several rows of one, or one conversation of many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fan_out(df: DataFrame, rows: Column) -> DataFrame:
    """One row for each struct of an array, with its fields as columns."""
    return df.withColumn("__x", F.explode(rows)).select(*df.columns, "__x.*")


def chunks(df: DataFrame, ids: str, most: int, labels: str | None = None) -> DataFrame:
    """Long token arrays cut into ceil(n / most) rows; each chunk's first label is masked."""
    n = F.ceil(F.size(ids) / most).cast("int")
    at = F.when(F.size(ids) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("chunk", F.explode(at)).withColumn("__i", F.slice(ids, F.col("chunk") * most + 1, F.lit(most)))
    if labels:
        cut = F.slice(labels, F.col("chunk") * most + 1, F.lit(most))
        out = out.withColumn(labels, F.transform(cut, lambda x, i: F.when(i == 0, F.lit(-100)).otherwise(x)))
    return out.withColumn(ids, F.col("__i")).drop("__i")


def paired_answers(df: DataFrame, question: str, answers: dict[str, str]) -> DataFrame:
    """One row for each answer column that is filled: question, answer, and which it was."""
    options = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(col).alias("answer")) for name, col in answers.items()])
    rest = [c for c in df.columns if c not in answers.values()]
    return df.select(*rest, F.explode(options).alias("x")).select(*rest, "x.*").where("answer is not null")


def repeated(df: DataFrame, times: int, name: str = "sequence") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def repeat_sampler(df: DataFrame, order: str, mini: int, batch: int, repeats: int) -> DataFrame:
    """Each batch of batch rows is given repeats times, each row mini times in a row."""
    out = df.withColumn("batch_id", F.floor(F.col(order) / batch))
    out = out.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))))
    return out.withColumn("place", ((F.col("batch_id") * repeats + F.col("round")) * batch + F.pmod(F.col(order), F.lit(batch))) * mini + F.col("copy"))


def sessions(df: DataFrame, partition: str, order: str, start: Column) -> DataFrame:
    """Adds session: a running count of starts within the partition; rows before the first start go."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(F.when(start, 1).otherwise(0)).over(w)).where("session > 0")


def gathered(df: DataFrame, keys: list[str], order: str, values: list[str], name: str = "items") -> DataFrame:
    """Rows of a group as one array of structs, in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias(name))
