"""The same operators over streams, and those that need state."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packing import best_fit
from ..sources.scratch import exists, folder


def read(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of files; the schema has to be given."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


class FileSink:
    """Writes each micro-batch into a folder of its own id, once: a batch that is there whole is left alone.

    A stream that was killed runs its last batch again under the same id and with the same rows, so a
    restarted stream gives the rows of one that was never stopped.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        to = f"{self.path}/batch={number}"
        if not exists(batch.sparkSession, f"{to}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(to)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows so far, without the batch they came in."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path).select(schema.fieldNames())


def run(df: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, as a batch table of files; new folders of the shared one unless they are given."""
    base = folder(df.sparkSession)
    sink = FileSink(path or f"{base}/rows")
    each(df, sink, checkpoint or f"{base}/checkpoint")
    return sink.read(df.sparkSession, df.schema)


def each(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """step(batch, id) for every micro-batch."""
    writer = df.writeStream.foreachBatch(step).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()


class Take:
    """The first n rows of a stream: validation gets the first val of them; one counter on the driver."""

    def __init__(self, n: int, val: int, key: str, sink: Callable[[DataFrame], None]):
        self.n, self.val, self.key, self.sink, self.seen = n, val, key, sink, 0

    def __call__(self, batch: DataFrame, _: int) -> None:
        left = self.n - self.seen
        if left <= 0:
            return
        rows = batch.orderBy(self.key).limit(left)
        got = rows.count()
        at = F.row_number().over(Window.orderBy(self.key)) + self.seen  # at most n rows
        self.sink(rows.withColumn("part", F.when(at <= self.val, "val").otherwise("train")))
        self.seen += got


# -- operators with state -----------------------------------------------------------------------


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream still holds: its state store as a table of key and value."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select("key.*", "value.groupState.*")


def packed(df: DataFrame, shard: str, key: str, length: str, volume: int) -> DataFrame:
    """(shard, turn, bin, members, lengths, total) of a stream, packed shard by shard.

    A shard's rows of a micro-batch are packed with its open bin, in order of key; the last bin stays open as state and
    the others come out. packed_rest() gives the open bins of a stream that has ended. A shard
    is one group, so shards should be many; its state is one bin.
    """
    rows = df.select(F.col(shard).cast("long").alias("shard"), F.col(key).cast("long").alias("id"), F.col(length).cast("long").alias("n"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, ids, lengths = state.get if state.exists else (0, [], [])
        new = pd.concat(list(parts)).sort_values("id")
        bins = best_fit([*zip(ids, lengths, strict=True), *zip(new["id"].tolist(), new["n"].tolist(), strict=True)], volume)
        last = bins.pop()
        state.update((turn + 1, [x for x, _ in last], [n for _, n in last]))
        yield pd.DataFrame([(k[0], turn, i, [x for x, _ in b], [n for _, n in b], sum(n for _, n in b)) for i, b in enumerate(bins)], columns=["shard", "turn", "bin", "members", "lengths", "total"])

    return rows.groupBy("shard").applyInPandasWithState(step, PACKED, "turn long, members array<long>, lengths array<long>", "append", GroupStateTimeout.NoTimeout)


def packed_rest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open bins at the end of a stream of packed(), one for each shard."""
    held = left_over(spark, checkpoint)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return held.select("shard", "turn", F.lit(0).alias("bin"), "members", "lengths", total.alias("total"))


PACKED = "shard long, turn long, bin int, members array<long>, lengths array<long>, total long"


def buffered(rows: list, seen: int, buffer: list, size: int, seed: str) -> Iterator[object]:
    """A shuffle through a buffer: once it is full, each new row takes the place of one drawn by hash, which comes out.

    rows go in from place seen on; the buffer is changed. What is left at the end comes out by drain().
    """
    for at, row in enumerate(rows, seen):
        if len(buffer) < size:
            buffer.append(row)
        else:
            place = zlib.crc32(f"{seed}:{at}".encode()) % size
            out, buffer[place] = buffer[place], row
            yield out


def drain(buffer: list, seed: str) -> list:
    """The rest of a buffer in hash order of its places."""
    return [buffer[i] for i in sorted(range(len(buffer)), key=lambda i: (zlib.crc32(f"{seed}:end:{i}".encode()), i))]


def shuffled(df: DataFrame, shard: str, key: str, size: int = 1000, seed: str = "shuffle") -> DataFrame:
    """(shard, pos, row) of a stream, shuffled shard by shard through a buffer of size rows that outlives micro-batches.

    A shard's rows of a micro-batch go in by key; row is the whole row as JSON, pos its place in the new order.
    shuffled_rest() gives what the buffers hold when the stream has ended.
    """
    rows = df.select(F.col(shard).cast("long").alias("shard"), F.col(key).alias("id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, buffer = state.get if state.exists else (0, [])
        buffer, new = list(buffer), pd.concat(list(parts)).sort_values(["id", "row"])["row"].tolist()
        first = max(0, seen - size)
        out = list(buffered(new, seen, buffer, size, seed))
        state.update((seen + len(new), buffer))
        yield pd.DataFrame({"shard": k[0], "pos": range(first, first + len(out)), "row": out})

    return rows.groupBy("shard").applyInPandasWithState(step, "shard long, pos long, row string", "seen long, buffer array<string>", "append", GroupStateTimeout.NoTimeout)


def shuffled_rest(spark: SparkSession, checkpoint: str, seed: str = "shuffle") -> DataFrame:
    """The rows that the buffers of shuffled() hold at the end, after those that came out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, seen, buffer in pdf.itertuples(index=False):
                out = drain(list(buffer), seed)
                yield pd.DataFrame({"shard": shard, "pos": range(seen - len(out), seen), "row": out})

    return left_over(spark, checkpoint).select("shard", "seen", "buffer").mapInPandas(run, "shard long, pos long, row string")


def sessions(df: DataFrame, key: str, order: str, start: Column) -> DataFrame:
    """(key, order, session) of a stream: sessions are counted per key across micro-batches.

    Rows of a key are taken in order within a batch; rows before the first start are dropped.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), start.cast("boolean").alias("starts"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        pdf = pd.concat(list(parts)).sort_values("at")
        session = now + pdf["starts"].astype("int64").cumsum()
        state.update((int(session.iloc[-1]),))
        out = pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "session": session})
        yield out[out["session"] > 0]

    return rows.groupBy("key").applyInPandasWithState(step, "key long, at long, session long", "session long", "append", GroupStateTimeout.NoTimeout)


def windows(df: DataFrame, time: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by time window and key, late rows within a watermark (a plain Spark feature)."""
    t = df.withColumn("__t", F.col(time).cast("timestamp"))
    if df.isStreaming:
        t = t.withWatermark("__t", late)
    return t.groupBy(F.window("__t", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def loop_complete(turns: Column, masks: Column, logprobs: Column) -> Column:
    """Whether a multi-turn trace can be used: an answer, and a mask and log-probability for each token."""
    return (F.size(turns) > 0) & F.forall(F.arrays_zip(masks.alias("m"), logprobs.alias("p")), lambda x: F.size(x["m"]) == F.size(x["p"]))
