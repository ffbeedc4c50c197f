"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..operators import filters, normalize
from ..streaming import streams
from .registry import query, table


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a table may be one file or a folder of files
    return streams.read(spark, f"{path}*", schema)


@query("select doc_id, md5('<|im_start|>user' || chr(10) || lang || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10)) as digest from documents")
def stream_prepare(spark, sf_dir):
    """Normalise, filter and render a stream with the same functions as a batch."""
    d = _stream(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer"))
    got = filters.drop_bad(normalize.normalize(d, keep=("doc_id",)))
    return streams.run(got.select("doc_id", F.md5(render.rendered(F.col("messages"))).alias("digest")))


@query("select user_id as key, event_id as at, session from (select user_id, event_id, sum((event_type = 'signup')::int) over (partition by user_id order by event_id)::bigint as session from events) where session > 0")
def stream_sessionise(spark, sf_dir):
    e = _stream(spark, sf_dir, "events")
    return streams.run(streams.sessions(e, "user_id", "event_id", F.col("event_type") == "signup"))


@query("select time_bucket(interval 1 day, ts)::timestamp as start, event_type, count(*) as n, sum(value) as total from events group by all")
def event_window(spark, sf_dir):
    """Tumbling windows; a plain Spark feature beside the rest."""
    return streams.windows(table(spark, sf_dir, "events"), "ts", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
