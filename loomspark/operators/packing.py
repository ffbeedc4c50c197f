"""Lengths, packing into fixed volumes, and fixed-size blocks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import even_split, key_blocks, ordered_positions

#: Rows that are packed together; bins never cross chunks in the independent mode.
CHUNK = 1000
#: Rows of a segment that is packed in order.
SEGMENT_ROWS = 200_000


def best_fit(items: list[tuple[int, int]], volume: int) -> list[list[tuple[int, int]]]:
    """Bins of (id, length): longest first, each into the fullest bin that still takes it."""
    bins: list[list[tuple[int, int]]] = []
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(room, (item[1], -1))
        if at < len(room) and item[1] <= volume:
            left, b = room.pop(at)
            bins[b].append(item)
            left -= item[1]
        else:
            bins.append([item])
            b, left = len(bins) - 1, volume - item[1]
        if left > 0:
            insort(room, (left, b))
    return bins


def pack(df: DataFrame, key: str, length: str, volume: int, chunk: int = CHUNK) -> DataFrame:
    """(chunk, bin, members, lengths, total): rows packed so that no bin exceeds the volume.

    Chunks of consecutive rows are packed independently, so the work spreads and the result
    does not depend on workers. A row longer than the volume has a bin of its own.
    """
    rows = ordered_positions(df.select(key, length), key).withColumn("chunk", F.floor(F.col("pos") / chunk))
    kind = "chunk long, bin int, members array<long>, lengths array<long>, total long"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(list(zip(g[key].tolist(), g[length].tolist(), strict=True)), volume)
        out = [(g["chunk"].iloc[0], i, [k for k, _ in b], [n for _, n in b], sum(n for _, n in b)) for i, b in enumerate(bins)]
        return pd.DataFrame(out, columns=["chunk", "bin", "members", "lengths", "total"])

    return rows.groupBy("chunk").applyInPandas(run, kind)


def packed_in_turns(rows: Iterator[list[tuple[int, int]]], volume: int, chunk: int) -> Iterator[tuple[int, list[list[tuple[int, int]]]]]:
    """(turn, bins): every turn packs chunk new rows with the last bin of the turn before, which comes out with the next."""
    held: list[tuple[int, int]] = []
    fresh: list[tuple[int, int]] = []
    turn = 0
    for part in rows:
        fresh += part
        while len(fresh) > chunk:  # one row more than the chunk: it is not the last
            *bins, held = best_fit(held + fresh[:chunk], volume)
            yield turn, bins
            turn, fresh = turn + 1, fresh[chunk:]
    if held or fresh:
        yield turn, best_fit(held + fresh, volume)


def pack_in_order(df: DataFrame, key: str, length: str, volume: int, chunk: int = CHUNK, segments: int | None = None) -> DataFrame:
    """(segment, chunk, bin, members, lengths, total): like pack(), but the last bin of a chunk is carried into the next.

    Carrying makes chunks depend on each other, so the rows in key order are cut into segments of equal size, each of
    which is packed in one task from first to last, as a stream: a task holds a chunk and a bin. The result depends
    on the number of segments (one for SEGMENT_ROWS rows unless it is given), not on partitions or workers.
    """
    total = df.count()
    segments = segments or max(1, -(-total // SEGMENT_ROWS))
    rows = even_split(df.select(key, length), key, segments).repartitionById(segments, F.col("part").cast("int")).sortWithinPartitions("part", key)
    kind = "segment int, chunk long, bin int, members array<long>, lengths array<long>, total long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[tuple[int, list[tuple[int, int]]]]:
            for pdf in batches:
                for segment, g in pdf.groupby("part"):
                    yield int(segment), list(zip(g[key].tolist(), g[length].tolist(), strict=True))

        for segment, own in groupby(parts(), lambda x: x[0]):
            for turn, bins in packed_in_turns((x for _, x in own), volume, chunk):
                yield pd.DataFrame([(segment, turn, i, [k for k, _ in b], [n for _, n in b], sum(n for _, n in b)) for i, b in enumerate(bins)], columns=["segment", "chunk", "bin", "members", "lengths", "total"])

    return rows.mapInPandas(run, kind)


def packed_positions(lengths: Column) -> Column:
    """Position ids of a pack: each member counts from 0."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def sequence_starts(position_ids: Column) -> Column:
    """Offsets where position ids start again, and the total length at the end."""
    at = F.filter(F.transform(position_ids, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    return F.concat(at, F.array(F.size(position_ids)))


def materialised_pack(packs: DataFrame, rows: DataFrame, key: str, ids: str, labels: str) -> DataFrame:
    """Concatenated ids, labels and position ids of each pack, members in pack order."""
    each = packs.select("chunk", "bin", F.posexplode("members").alias("at", key)).join(rows, key)
    lists = each.groupBy("chunk", "bin").agg(F.array_sort(F.collect_list(F.struct("at", F.col(ids).alias("ids"), F.col(labels).alias("labels")))).alias("m"))
    return lists.select("chunk", "bin", F.flatten("m.ids").alias("input_ids"), F.flatten("m.labels").alias("labels"), packed_positions(F.transform("m.ids", lambda x: F.size(x).cast("long"))).alias("position_ids"))


def length_stats(df: DataFrame, length: Column, by: list[str] | None = None) -> DataFrame:
    """mean, population deviation, min, max and count."""
    return df.groupBy(*(by or [])).agg(F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"), F.min(length).alias("min"), F.max(length).alias("max"), F.count(length).alias("size"))


def total_length(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def blocks(df: DataFrame, key: str, tokens: str, size: int) -> DataFrame:
    """All tokens in key order, cut into blocks of size; the incomplete last block goes.

    Offsets come from sums over ranges of the key, so no window runs over all rows; rows are
    then split at block edges and only the pieces are regrouped.
    """
    rows = key_blocks(df.withColumn("__n", F.size(tokens).cast("long")), key, F.col("__n"))
    inside = F.sum("__n").over(Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    at = rows.withColumn("__i", inside).withColumn("__s", F.col("__b") + F.col("__i")).where("__n > 0")
    first, last = F.floor(F.col("__s") / size), F.floor((F.col("__s") + F.col("__n") - 1) / size)
    piece = at.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * size - F.col("__s"), F.lit(0))
    hi = F.least((F.col("block") + 1) * size - F.col("__s"), F.col("__n"))
    piece = piece.select("block", "__s", F.slice(tokens, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    out = piece.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("__s", "t"))).alias("p"))
    return out.select("block", F.flatten("p.t").alias("tokens")).where(F.size("tokens") == size)
