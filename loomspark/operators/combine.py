"""Set operations and lookups between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import draw_order, key_blocks, positions

#: Most rows of a lookup side that is broadcast without looking at sizes.
LOOKUP_ROWS = 10_000


def concat(frames: list[DataFrame]) -> DataFrame | None:
    """All rows; missing columns are null. Nothing gives None, one frame itself."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def interleave(df: DataFrame, source: str, key: str, weights: dict[str, float], stop: str = "first_exhausted") -> DataFrame:
    """Merge sources in proportion to their weights, deterministically.

    Row number i of a source stands at (i + 0.5) / weight on a common line; rows are read in
    the order of that line. first_exhausted cuts where the first source ends; all_exhausted
    repeats shorter sources until the longest one ends.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(k, float(w)) for k, w in weights.items() if w > 0], f"{source} string, weight double")
    rows = df.join(F.broadcast(table), source)  # as many rows as there are named weights
    at = positions(rows, draw_order("interleave", key), key, by=[source])
    ends = rows.groupBy(source, "weight").agg(F.count("*").alias("n"))
    line = ends.select(source, "n", (F.col("n") / F.col("weight")).alias("end"))
    edge = line.agg((F.min("end") if stop == "first_exhausted" else F.max("end")).alias("edge"))
    limits = F.broadcast(line.select(source, "n").join(edge))  # one row for each source
    out = at.join(limits, source)
    if stop != "first_exhausted":
        times = F.greatest(F.ceil(F.col("edge") * F.col("weight") / F.col("n")), F.lit(1)).cast("int")
        out = out.withColumn("turn", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("pos", F.col("pos") + F.col("turn") * F.col("n")).drop("turn")
    out = out.withColumn("place", (F.col("pos") + 0.5) / F.col("weight")).where(F.col("place") <= F.col("edge"))
    return out.select(*df.columns, "place")


def distinct_by(df: DataFrame, column: str) -> DataFrame:
    return df.dropDuplicates([column])


def dense_ids(df: DataFrame, column: str, order: str, name: str = "group_id") -> DataFrame:
    """Dense 0-based ids of distinct values in order of first appearance; order is an integer column, ties go by value."""
    first = key_blocks(df.groupBy(column).agg(F.min(order).alias("__first")), "__first", F.lit(1).cast("long"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__first", column)) - 1
    ids = first.select(column, (inside + F.col("__b")).cast("long").alias(name))
    return df.join(ids, df[column].eqNullSafe(ids[column])).drop(ids[column])


def row_key(*columns: str) -> Column:
    """md5 of a row as JSON with sorted keys: the key of a result cache."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])))


def cache_probe(rows: DataFrame, cache: DataFrame, key: str, want: int) -> DataFrame:
    """hit if the cache holds exactly want results for the row's key."""
    counts = cache.groupBy(key).agg(F.count("*").alias("cached"))
    out = rows.join(counts, key, "left").withColumn("cached", F.coalesce("cached", F.lit(0)))
    return out.withColumn("hit", F.col("cached") == want)


def route(df: DataFrame, channel: str, table: dict[str, int], name: str = "route") -> DataFrame:
    """Channel -> index; null or unknown channels take 0."""
    if not table:
        return df.withColumn(name, F.lit(0))
    if len(table) > LOOKUP_ROWS:
        raise ValueError("use a join for a table of this size")
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(lookup, F.col(channel)), F.lit(0)))


def members(requests: DataFrame, rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """For each requested key, its rows as an array in order."""
    wanted = rows.join(requests.select(key).distinct(), key, "left_semi")
    return wanted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))


def shifted_pairs(df: DataFrame, batch: str, order: str, value: str, name: str = "shifted") -> DataFrame:
    """Each row gets the value of the row before it in its batch; the first gets the last one's."""
    w = Window.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, F.last(value).over(whole)).otherwise(F.lag(value).over(w)))


def merge_outputs(inputs: DataFrame, outputs: DataFrame, key: str = "request_id", finish: str = "finish_reason") -> DataFrame:
    """Outputs beside the first input of their request; is_truncated where the length ran out."""
    out = outputs.join(inputs.dropDuplicates([key]), key)
    return out.withColumn("is_truncated", F.coalesce(F.col(finish) == "length", F.lit(False)))


def desirability_weights(df: DataFrame, label: str) -> DataFrame:
    """Counts of desirable and undesirable rows, and the ranges of weights that balance them 1:1 to 4:3."""
    pos, neg = F.sum(F.col(label).cast("int")), F.sum(1 - F.col(label).cast("int"))
    out = df.agg(pos.alias("desirable"), neg.alias("undesirable"))
    d, u = F.greatest("desirable", F.lit(1)), F.greatest("undesirable", F.lit(1))
    return out.select("desirable", "undesirable", F.round(u / d, 2).alias("des_low"), F.round(u * 1.33 / d, 2).alias("des_high"), F.round(d / (u * 1.33), 2).alias("und_low"), F.round(d / u, 2).alias("und_high"))


def realigned(requests: DataFrame, responses: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Every (request, sequence number) with its response, null where none came back."""
    return requests.join(responses.select(key, seq, value).dropDuplicates([key, seq]), [key, seq], "left")
