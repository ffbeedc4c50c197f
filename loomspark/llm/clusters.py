"""Links inside clusters of any size: small clusters in one task, large ones in rounds over blocks.

A cluster is a set of members outside of which no member has a link. An operator gives a
function that compares some members of a group (the centres) with all others; only members that
are not yet connected need comparing, since components are what is asked for. Small clusters
take every member as a centre in one pass. Large ones go in rounds: the most central few
centres first, four times as many each round, against all blocks of members, until no two
members that were never centres are unconnected. No pair is skipped, and a large group of near
copies needs a round or two, not its square. A cluster whose members are all unlike does cost its square in
comparisons; its blocks then hold BLOCK_BYTES, so that the rows sent stay few: a cluster of n
members in b blocks sends 2 * n * b rows, with b = 16 for 100,000 sets of 4 kB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, materialise

#: Members up to which one task finishes a cluster; members of a block at least; centres of the first round.
SMALL, BLOCK, CENTRES = 200, 1000, 16
#: Blocks of a large cluster, unless its members' bytes need more of BLOCK_BYTES each.
BLOCKS, BLOCK_BYTES = 16, 32 << 20

#: (rows of a group sorted by id, their labels as numbers, positions of the centres) -> (positions of links, labels then)
Compare = Callable[[pd.DataFrame, np.ndarray, list[int]], tuple[list[tuple[int, int]], np.ndarray]]


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by the given columns."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i or (rest and tuple(rest[-1][by].iloc[-1]) != tuple(keys[s])):
                if rest:
                    yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(pdf.iloc[s:e])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def clusters_of(stars: DataFrame, sizes: DataFrame, files: int) -> DataFrame:
    """id, cluster, weight, n (members) and blocks of every member.

    stars: id, least, weight (a link that may be one, from a member to the least of its bucket);
    sizes: id, bytes that a member takes.
    """
    found = materialise(components(stars.select(F.col("id").alias("a"), F.col("least").alias("b")), files), files)
    central = stars.groupBy("id").agg(F.sum("weight").alias("weight"))
    members = found.withColumnRenamed("component", "cluster").join(central, "id", "left").na.fill(0, ["weight"]).join(sizes.select("id", "bytes"), "id")
    blocks = F.greatest(F.least(F.ceil(F.count("*") / BLOCK), F.lit(BLOCKS)), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    counts = members.groupBy("cluster").agg(F.count("*").alias("n"), blocks.alias("blocks"))
    out = materialise(members.drop("bytes").join(counts, "cluster").select("id", "cluster", "weight", "n", "blocks"), files)
    discard(found)
    return out


def links(members: DataFrame, compare: Compare, whole: bool) -> DataFrame:
    """Links (a, b) inside groups (cluster, block, part); rows also have id, label, centre and what compare reads.

    With whole, the groups are whole clusters with all members as centres, and the links are
    those of each member to the least one of its component.
    """
    by = ["cluster", "block", "part"]
    ordered = members.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, by):
            g = g.sort_values(["id", "centre"]).drop_duplicates("id", keep="last")
            if len(g) < 2:
                continue
            ids, centre = g["id"].to_numpy(), g["centre"].to_numpy()
            label = np.unique(g["label"].to_numpy(), return_inverse=True)[1]
            found, of = compare(g, label, np.flatnonzero(centre > 0).tolist())
            if whole:
                least = np.full(of.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, of, ids)
                hangs = least[of] != ids
                yield pd.DataFrame({"a": ids[hangs], "b": least[of][hangs]})
            elif found:
                a, b = np.array(found).T
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return ordered.mapInPandas(run, "a long, b long")


def settle(sets: DataFrame, payload: list[str], compare: Compare, files: int) -> DataFrame:
    """id, component (least id that links reach) of every member with a link.

    sets: id, cluster, weight, n, blocks and the payload, one row a member or equal rows.
    """
    keep = partial(materialise, files=files)
    one = F.lit(0)
    small = sets.where(F.col("n") <= SMALL).select("id", "cluster", one.alias("block"), one.alias("part"), F.col("id").alias("label"), F.lit(1).alias("centre"), *payload)
    found = keep(links(small, compare, True)).select(F.col("a").alias("id"), F.col("b").alias("component"))
    large = sets.where(F.col("n") > SMALL)
    state = keep(large.select("id", "cluster", "weight", "n", "blocks", F.col("id").alias("label"), F.lit(False).alias("was")).dropDuplicates(["id"]))
    last, take = None, CENTRES
    every: Callable[[Column], Column] = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    while not state.isEmpty():
        top = Window.partitionBy("cluster").orderBy(F.desc("weight"), "id")
        centres = state.where("not was").withColumn("place", F.row_number().over(top)).where(F.col("place") <= take)
        each = F.ceil(F.col("n") / F.col("blocks"))
        centres = keep(centres.select("id", "cluster", "blocks", "label", F.floor((F.col("place") - 1) / each).cast("int").alias("part")))
        parts = centres.groupBy("cluster").agg((F.max("part") + 1).alias("parts"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        targets = state.join(parts, "cluster").select("id", "cluster", block.alias("block"), every(F.col("parts")).alias("part"), "label", F.lit(0).alias("centre"))
        sent = centres.select("id", "cluster", every(F.col("blocks")).alias("block"), "part", "label", F.lit(1).alias("centre"))
        pairs = targets.unionByName(sent).join(large.select("id", *payload), "id")
        new = links(pairs, compare, False)
        if last is not None:  # earlier rounds' links, as each member's link to the least of its component
            new = new.unionByName(last.select(F.col("id").alias("a"), F.col("component").alias("b")))
        joined = keep(components(new, files))
        now = state.drop("label").join(joined.withColumnRenamed("component", "label"), "id", "left").join(centres.select("id", F.lit(True).alias("new")), "id", "left")
        now = now.select("id", "cluster", "weight", "n", "blocks", F.coalesce("label", "id").alias("label"), (F.col("was") | F.coalesce("new", F.lit(False))).alias("was"))
        open_ = now.where("not was").groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cluster")
        rest = keep(now.join(open_, "cluster", "left_semi"))
        for old in (state, centres, last):
            if old is not None:
                discard(old)
        state, last = rest, joined
        take *= 4
    return found if last is None else found.unionByName(last)
