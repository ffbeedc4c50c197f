"""Results that do not depend on partitions, and work that stays bounded when ids repeat or lack."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import clusters, common, mixing, neardup, toxicity

from .test_corpus import docs_of, prose


def tied(spark):
    r = random.Random(9)
    texts = [prose(r, 20, 10**6) for _ in range(400)] + [prose(r, 20, 10**6) for _ in range(100)] + [prose(r, r.randint(0, 60)) for _ in range(200)] + ["one and the same"] * 150
    ids = [None] * 400 + [7] * 100 + list(range(1000, 1200)) + [8] * 150
    sources = [r.choice(["a", "b", None]) for _ in texts]
    return docs_of(spark, texts, ids, sources)


def test_mix_takes_the_same_texts_from_any_partitions(spark, monkeypatch):
    df = tied(spark)
    take = lambda d: collections.Counter(tuple(x) for x in mixing.mix(d, keep=("doc_id", "text", "source")).select("doc_id", "text", "source", "copies").collect())
    want = take(df)
    assert take(df.repartition(7)) == want and take(df.orderBy(F.desc("text")).coalesce(1)) == want
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)
    monkeypatch.setattr(mixing, "RANGES", 4)
    assert take(df.repartition(5)) == want
    free = sum(n for k, n in want.items() if k[0] is None and k[3])
    assert 150 < free < 400


def test_mix_spreads_rows_without_id(spark):
    slices = mixing.mix(tied(spark).where("doc_id is null"), keep=("doc_id",))
    assert slices.count() == 400
    pipeline = pytest.importorskip("corpus_pipeline")
    df = tied(spark)
    mixed = [collections.Counter(tuple(x) for x in pipeline.mix_sources(spark, d, "").collect()) for d in (df, df.repartition(6))]
    assert mixed[0] == mixed[1]


def test_repeated_labelled_ids_reach_the_driver_once(spark, monkeypatch):
    r = random.Random(3)
    rows = docs_of(spark, ["vile " + prose(r, 5) for _ in range(3000)] + [prose(r, 30) for _ in range(9)], [1] * 3000 + list(range(2, 11)))
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 11)], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda x, *a: (seen.append(len(x)), fit(x, *a))[1])
    toxicity.fit_from(rows, labels, 10)
    assert seen == [10]
    again = [toxicity.fit_from(d, labels, 10) for d in (rows, rows.repartition(5))]
    assert again[0].weights == again[1].weights and again[0].reject == again[1].reject


def test_large_clusters_have_few_blocks(spark):
    n = 3000
    stars = spark.range(1, n).select("id", F.lit(0).cast("long").alias("least"), F.lit(1).cast("long").alias("weight"))
    sizes = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 100).otherwise(60_000).cast("long").alias("bytes"))
    got = clusters.clusters_of(stars, sizes, 4).agg(F.count("*"), F.max("n"), F.min("blocks"), F.max("blocks")).first()
    assert tuple(got) == (n, n, 3, 3)
    big = clusters.clusters_of(stars, sizes.withColumn("bytes", F.lit(1 << 20)), 4).first()["blocks"]
    assert big == -(-n * (1 << 20) // clusters.BLOCK_BYTES)


def test_near_copies_keep_columns_of_any_name(spark):
    df = docs_of(spark, ["a b c d e f", "a b c d e f", "other words that are here only", None], [1, 2, 3, None]).withColumns({c: F.lit(c) for c in ("__doc", "__key", "__row", "id", "regs")})
    got = neardup.without_near_copies(df)
    assert got.columns == df.columns and sorted((x["doc_id"], x["__doc"], x["__key"]) for x in got.collect() if x["doc_id"]) == [(1, "__doc", "__key"), (3, "__doc", "__key")]
    assert common.WORD_CLASS
