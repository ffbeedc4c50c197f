"""Streams that stop and start again, packing in order, ranges of uneven keys."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark import plans
from loomspark.operators import packing, sampling
from loomspark.streaming import streams

from .compare import DATA


class Broken:
    """A sink that loses one batch half written, once."""

    def __init__(self, sink, at):
        self.sink, self.at, self.seen = sink, at, []

    def __call__(self, batch, number):
        self.seen.append(number)
        if number == self.at:
            self.at = None
            batch.limit(1).write.mode("overwrite").parquet(f"{self.sink.path}/batch={number}/_temporary/part")
            raise RuntimeError("stopped")
        self.sink(batch, number)


def broken_off(spark, df, tmp_path, name, at=1):
    """df run with a break in a batch, then again from its checkpoint."""
    sink, checkpoint = streams.FileSink(str(tmp_path / name)), str(tmp_path / f"{name}-checkpoint")
    step = Broken(sink, at)
    with pytest.raises(Exception, match="stopped"):
        streams.each(df, step, checkpoint)
    streams.each(df, step, checkpoint)
    assert step.seen.count(at) == 2
    sink(spark.createDataFrame([], df.schema), 0)  # a batch that is there is left alone
    return sink.read(spark, df.schema), checkpoint


def test_broken_streams_equal_their_plain_versions(spark, tmp_path):
    r = random.Random(1)
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, r.randint(1, 9)) for i in range(90)], "id long, n long").repartition(5, "id").write.parquet(src)
    source = streams.read(spark, src, "id long, n long", files=1)
    once = lambda df: [tuple(x) for x in df.collect()]
    doubled = source.select("id", (2 * F.col("n")).alias("n"))
    rows, _ = broken_off(spark, doubled, tmp_path, "map")
    assert sorted(once(rows)) == sorted((i, 2 * n) for i, n in once(spark.read.parquet(src)))

    sharded = source.withColumn("shard", F.col("id") % 3)
    bins, checkpoint = broken_off(spark, streams.packed(sharded, "shard", "id", "n", 20), tmp_path, "pack", 2)
    bins = bins.unionByName(streams.packed_rest(spark, checkpoint)).collect()
    assert sorted(i for b in bins for i in b["members"]) == list(range(90)) and all(b["total"] == sum(b["lengths"]) <= 20 for b in bins)
    assert len({(b["shard"], b["turn"], b["bin"]) for b in bins}) == len(bins) and max(b["turn"] for b in bins) > 2

    out, checkpoint = broken_off(spark, streams.shuffled(sharded, "shard", "id", 8, "x"), tmp_path, "shuffle", 3)
    out = out.unionByName(streams.shuffled_rest(spark, checkpoint, "x")).collect()
    whole = streams.run(streams.shuffled(sharded, "shard", "id", 8, "x"), checkpoint=str(tmp_path / "again"))
    whole = whole.unionByName(streams.shuffled_rest(spark, str(tmp_path / "again"), "x")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, whole))
    for shard in range(3):
        mine = sorted((x["pos"], json.loads(x["row"])["id"]) for x in out if x["shard"] == shard)
        assert [p for p, _ in mine] == list(range(30)) and sorted(i for _, i in mine) == list(range(shard, 90, 3)) and [i for _, i in mine] != sorted(i for _, i in mine)


def test_buffered_shuffle_of_one_batch(spark, tmp_path):
    """One micro-batch: the stream equals its plain version row by row."""
    src = str(tmp_path / "in")
    spark.range(2500).coalesce(1).write.parquet(src)
    df = streams.read(spark, src, "id long").withColumn("shard", F.lit(0))
    out = streams.run(streams.shuffled(df, "shard", "id", 1000, "s"), checkpoint=str(tmp_path / "c"))
    got = out.unionByName(streams.shuffled_rest(spark, str(tmp_path / "c"), "s")).orderBy("pos").collect()
    buffer: list = []
    want = list(streams.buffered(list(range(2500)), 0, buffer, 1000, "s"))
    want += streams.drain(buffer, "s")
    assert [json.loads(x["row"])["id"] for x in got] == want and sorted(want) == list(range(2500)) and len(buffer) == 1000


@pytest.mark.parametrize("segments", [1, 3])
def test_packing_in_order_equals_its_plain_version(spark, segments):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 5, 30, 64, 90])) for i in range(500)]
    got = {}
    for df in (spark.createDataFrame(rows, "id long, n long"), spark.createDataFrame(rows[::-1], "id long, n long").repartition(7)):
        got = {(x["segment"], x["chunk"], x["bin"]): list(zip(x["members"], x["lengths"], strict=True)) for x in packing.pack_in_order(df, "id", "n", 64, 50, segments).collect()}
        want, at = {}, 0
        for s in range(segments):
            size, turn, held = 500 // segments + (s < 500 % segments), 0, []
            part = rows[at : at + size]
            at += size
            for c in range(0, size, 50):
                bins = packing.best_fit(held + part[c : c + 50], 64)
                if c + 50 < size:
                    held = bins.pop()
                want |= {(s, turn, i): b for i, b in enumerate(bins)}
                turn += 1
        assert got == want
    assert packing.pack_in_order(spark.createDataFrame([], "id long, n long"), "id", "n", 64).count() == 0


@pytest.mark.parametrize("ids", [[*range(3000), 2**62], [-(2**63), 2**63 - 1, *range(2000)], [int(1.004**i) + i for i in range(4000)], list(range(-1500, 0)), [], [7]])
def test_ranges_of_uneven_keys(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    groups = sampling.key_blocks(df, "id", F.lit(1).cast("long"), per=100).groupBy("__r").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("__b").alias("before")).orderBy("__r").collect()
    at = 0
    for g in groups:
        assert g["before"] == at
        at += g["n"]
    assert at == len(ids) and all(a["hi"] < b["lo"] for a, b in zip(groups, groups[1:], strict=False))
    assert not ids or max(g["n"] for g in groups) <= 2 * max(100, len(ids) / len(groups))


def test_first_rows_of_an_order(spark):
    df = spark.range(300).withColumn("good", F.col("id") % 3 == 0)
    order = [x["id"] for x in df.orderBy(sampling.draw_order("backup", "id"), "id").collect()]
    backup = [i for i in order if i % 3 == 0]
    got = sampling.topped_up(df.where("id < 60"), df, F.col("good"), "id", 50)
    assert sorted(x["id"] for x in got.collect()) == sorted([*range(0, 60, 3), *backup[:30]])
    assert sampling.topped_up(df, df, F.col("good"), "id", 7).count() == 7
    with pytest.raises(ValueError):
        sampling.topped_up(df, df, F.col("good"), "id", 201)


def plain_bins(items, volume):
    """Longest first, each into the fullest bin with room, by looking at every bin."""
    bins = []
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        room = [(volume - sum(n for _, n in b) - item[1], i) for i, b in enumerate(bins)]
        fits = [x for x in room if x[0] >= 0 and x[0] + item[1] > 0]
        if fits:
            bins[min(fits)[1]].append(item)
        else:
            bins.append([item])
    return bins


def test_packed_documents_equal_their_plain_version(spark):
    """The query over whole texts, chunk by chunk."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    lengths = [(x["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or ""))) for x in docs]
    want = {}
    for c in range(0, len(lengths), packing.CHUNK):
        want |= {(c // packing.CHUNK, i): b for i, b in enumerate(plain_bins(lengths[c : c + packing.CHUNK], 4096))}
    got = {(x["chunk"], x["bin"]): list(zip(x["members"], x["lengths"], strict=True)) for x in plans.QUERIES["pack_bins"](spark, DATA).collect()}
    assert got == want
