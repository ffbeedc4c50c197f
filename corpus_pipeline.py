"""A corpus pipeline: reject toxic documents, drop near copies, redact secrets, mix sources, encode.

Every stage takes all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, mixing, neardup, secrets, toxicity
from loomspark.llm.common import bound_batches, cleared, remove, scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "word_bpe_49k.json"
#: Percent of common five-word shingles from which two documents are near copies.
SIMILAR = 80
#: Words whose tokens a worker keeps; its caches stay beside the memory that earlier stages left.
REMEMBER = 400_000
#: SQL cannot express the fitted stages; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    bound_batches(spark)
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(~toxicity.toxic_column(model, F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of SIMILAR percent or more make; rows without doc_id all stay."""
    return neardup.without_near_copies(docs.select(*COLUMNS), SIMILAR)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    bound_batches(spark)
    out = docs.select(*COLUMNS).withColumn("text", secrets.redacted_column(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    mixed = mixing.mix(docs, keep=COLUMNS)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), keep=("doc_id", "source"), remember=REMEMBER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder; what a stage needed goes when its rows are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
