"""Row filters: what makes a row bad, as predicates that Catalyst can push."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.bind import let


def valid_messages(col: Column) -> Column:
    """Not empty, known roles, no null content."""
    return F.coalesce((F.size(col) > 0) & F.forall(col, lambda m: m["role"].isin(*S.ROLES) & m["content"].isNotNull()), F.lit(False))


def valid_rejected(messages: Column, rejected: Column) -> Column:
    """The rejected answer is there and differs from the last content."""
    return F.coalesce(rejected.isNotNull() & (rejected != F.element_at(messages, -1)["content"]), F.lit(False))


def drop_bad(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with invalid messages (or rejected_response) go; strict raises instead."""
    if "messages" not in df.columns:
        return df
    good = valid_messages(F.col("messages"))
    if "rejected_response" in df.columns:
        good = good & valid_rejected(F.col("messages"), F.col("rejected_response"))
    if strict:
        return df.withColumn("messages", F.when(good, F.col("messages")).otherwise(F.raise_error(F.lit("a row has invalid messages")).cast(df.schema["messages"].dataType)))
    return df.where(good)


def by_length(df: DataFrame, most: int, length: str = "length") -> DataFrame:
    """Rows whose length (or greatest of several lengths) is within most."""
    col = F.col(length)
    return df.where((F.array_max(col) if df.schema[length].dataType.typeName() == "array" else col) <= most)


def existing(df: DataFrame, column: str, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is listed in files."""
    return df.join(files.select(F.col(path).alias(column)).distinct(), column, "left_semi")


def all_existing(df: DataFrame, column: str, key: str, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of which every path of an array is listed: no path may be missing."""
    missing = df.select(key, F.explode(column).alias("__p")).join(files.select(F.col(path).alias("__p")).distinct(), "__p", "left_anti").select(key).distinct()
    return df.join(missing, key, "left_anti")


def overlapping(spans: Column) -> Column:
    """Whether any two [start, end) spans (structs) overlap."""
    meet = lambda s: F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: (i < F.size(s)) & (F.get(s, i)["start"] < F.get(s, i - 1)["end"]))
    return let(meet, F.array_sort(spans))


def alias_present(tags: Column, known: list[str]) -> Column:
    """Every tag is one of the known ones."""
    return F.forall(tags, lambda t: t.isin(*known))


def redraw(df: DataFrame, good: Column, key: str, seed: str = "redraw", tries: int = 10) -> DataFrame:
    """Bad rows are replaced by good ones drawn by hash; the number of rows stays."""
    from .sampling import draw_order, first_positions

    flagged = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    fine = flagged.where("__good").drop("__good")
    short = flagged.where("not __good").count()
    return fine if not short else fine.unionByName(first_positions(fine, draw_order(seed, key), short, key))
