"""Registered queries of the corpus operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import balltree, bpe, htmltext, mixing, neardup, nndescent, prefixjoin, repeats, secrets, spelling, spotsigs, toxicity, urlfilter
from .common import table

#: The vocabulary of the registered query; any other file is a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op2_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_from(docs, table(spark, sf_dir, "labels")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.jaccard_join(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_url, op3_spotsigs, op4_repeats, op5_neardup, op6_neighbours, op7_bpe, op8_secrets, op9_mixing, op10_toxicity, op11_ngram_join, op12_hard_negatives, op13_spelling)
}

ORACLE_SQL: dict[str, str] = {"op2_url": urlfilter.SQL, "op3_spotsigs": spotsigs.SQL, "op4_repeats": repeats.SQL, "op5_neardup": neardup.SQL, "op9_mixing": mixing.SQL, "op11_ngram_join": prefixjoin.SQL, "op12_hard_negatives": balltree.SQL}
