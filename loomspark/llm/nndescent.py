"""Approximate nearest neighbours by NN-descent and greedy graph search.

Build: equal vectors fall into one class. Sign patterns of random directions put the classes into
small buckets, and one more table deals them out at random, so that a class that is alone
in its corner has neighbours too. Then each round joins the neighbours of neighbours: every node
gathers its neighbours and those that have it as neighbour, compares them in blocks,
and passes on only pairs that beat what a member already has. Search: every query walks the
graph greedily, a beam of best nodes at a time, by joins of its frontier with the adjacency
lists, until no node of its beam is unexpanded. The lists hold a few random links as well; a
query that still ends with fewer than k candidates is compared with all nodes, in blocks.

The graph is built and walked on the original components, scored in double precision, so that
near copies closer together than any rounding step keep their order; all nodes of a beam are
scored again in one fixed order of summing.

Skew: buckets and hubs with more than two blocks of members are split by a hash that differs
between rounds; a list that very many queries want at once is dealt out to several tasks; what
a hub is offered is reduced to its best in every batch before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, files_for, materialise

#: Neighbours of a node in the graph, and in the lists that search walks (both directions, then random links).
NEIGHBOURS, WALKED, RANDOM = 24, 40, 2
#: Tables of random sign patterns for the first graph, classes aimed at for one bucket, and for one random bucket.
TABLES, BUCKET, DEALT = 6, 128, 32
#: Members of a block, pairs a member passes on from a block, rounds at most.
BLOCK, PASSED, ROUNDS = 128, 10, 4
#: Nodes of a query's beam, and nodes expanded at a time.
BEAM, STEP = 200, 100
#: A round that renews a smaller share of the neighbours than this is the last.
RENEWED = 0.02
#: Queries that one task serves from one list in a step.
SERVED = 512
#: Nodes and queries of one block where a query is compared with everything.
EXACT_NODES, EXACT_QUERIES = 20_000, 1000
GRAPH = "id long, nbrs array<long>, sims array<double>"


def packed(x: np.ndarray) -> bytes:
    """The bytes of one component, then the components as they are (float32 or double)."""
    return bytes([x.itemsize]) + x.tobytes()


def unpacked(rows) -> np.ndarray:
    """Vectors as doubles."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 1:].copy().view(np.float32 if raw[0, 0] == 4 else np.float64).astype(np.float64)


def clean(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding) rows that take part: no nulls, finite, not zero, of the commonest length."""
    e = F.col(vector).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes["n"] if sizes else 0))


def _best(ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct neighbours of each id, by id, then best first; ties go to the smaller neighbour."""
    order = np.lexsort((-sims, nbrs, ids))
    ids, nbrs, sims = ids[order], nbrs[order], sims[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, sims = ids[first], nbrs[first], sims[first]
    order = np.lexsort((nbrs, -sims, ids))
    ids, nbrs, sims = ids[order], nbrs[order], sims[order]
    place = np.arange(len(ids)) - np.searchsorted(ids, ids)
    good = place < k
    return ids[good], nbrs[good], sims[good]


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(pdf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(pdf["id"].to_numpy(), [len(x) for x in pdf["nbrs"]]), np.concatenate(pdf["nbrs"].tolist()), np.concatenate(pdf["sims"].tolist())


def _listed(ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
    """One row for each id of arrays that are sorted by id."""
    cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    starts = np.concatenate([[0], cut]) if len(ids) else cut
    split = lambda x: pd.Series(np.split(x, cut) if len(ids) else [], dtype=object)
    return pd.DataFrame({"id": ids[starts].astype(np.int64), "nbrs": split(nbrs), "sims": split(sims)})


def _merged(candidates: DataFrame, k: int) -> DataFrame:
    """(id, nbrs, sims) from rows of the same form, k best of each id; every batch is reduced before the shuffle."""

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _listed(*_best(*_flat(pdf), k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _flat(pd.DataFrame(columns=["id", "nbrs", "sims"]))
        for pdf in batches:
            held = _best(*map(np.concatenate, zip(held, _flat(pdf), strict=True)), k)
            if len(held[0]):
                last = np.searchsorted(held[0], held[0][-1])
                if last:
                    yield _listed(*(x[:last] for x in held))
                held = tuple(x[last:] for x in held)
        if len(held[0]):
            yield _listed(*held)

    return candidates.mapInPandas(reduced, GRAPH).repartition("id").sortWithinPartitions("id").mapInPandas(run, GRAPH)


def _compared(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """For each member of each group, up to k others of its block that beat its least similarity.

    Rows are sorted by group; a block ends with its group or at two BLOCKs of members.
    """
    held: list[pd.DataFrame] = []

    def blocks(pdf: pd.DataFrame, whole: bool) -> Iterator[tuple[int, int]]:
        cut = np.flatnonzero(np.diff(pdf["group"].to_numpy())) + 1
        for s, e in zip([0, *cut], [*cut, len(pdf)], strict=True):
            for at in range(s, e, 2 * BLOCK):
                if whole or e < len(pdf) or e - at >= 2 * BLOCK:
                    yield at, min(e, at + 2 * BLOCK)

    def best(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, least = pdf["id"].to_numpy(), unpacked(pdf["vec"].tolist()), pdf["least"].to_numpy()
        s = x @ x.T
        s[(ids[:, None] == ids) | (s <= least[:, None])] = -np.inf
        n = min(k, len(ids) - 1)
        if n < 1:
            return ids[:0], ids[:0], least[:0]
        near = np.argpartition(-s, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(s, near, 1)
        at, j = np.nonzero(value > -np.inf)
        return ids[at], ids[near[at, j]], value[at, j]

    for pdf in batches:
        pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        found, done = [], 0
        for s, e in blocks(pdf, False):
            found.append(best(pdf.iloc[s:e]))
            done = e
        held = [pdf.iloc[done:]]
        if any(len(x[0]) for x in found):
            yield _listed(*_best(*(np.concatenate(x) for x in zip(*found, strict=True)), k))
    found = [best(pdf.iloc[s:e]) for pdf in held for s, e in blocks(pdf, True)]
    if any(len(x[0]) for x in found):
        yield _listed(*_best(*(np.concatenate(x) for x in zip(*found, strict=True)), k))


def _offers(links: DataFrame, members: DataFrame, k: int, turn: int) -> DataFrame:
    """Best pairs inside the groups of distinct links (group, id); members: id, vec, least.

    Groups of more than two blocks, such as hubs, are split by a hash of the member.
    """
    large = links.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK)
    # never empty, so that the join below is planned alike with and without hubs
    none = links.sparkSession.range(1).select(F.lit(-(1 << 63)).alias("group"), F.lit(1).cast("long").alias("ways"))
    large = materialise(large.select("group", F.ceil(F.col("n") / BLOCK).alias("ways")).unionByName(none))
    part = F.xxhash64("group", F.pmod(F.xxhash64("id", F.lit(turn)), "ways"))
    split = links.join(large, "group", "left").select(F.when(F.col("ways").isNull(), F.col("group")).otherwise(part).alias("group"), "id")
    rows = split.join(members, "id").select("group", "id", "vec", "least")
    ordered = rows.repartition("group").sortWithinPartitions("group", F.xxhash64("group", "id"))
    return ordered.mapInPandas(lambda batches: _compared(batches, k), GRAPH)


def build(nodes: DataFrame, n: int, dim: int, files: int | None = None, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """Neighbour graph (id, nbrs, sims) of nodes (id, vec)."""
    bits = max(1, int(np.log2(max(1, n / BUCKET))))
    ways = np.random.default_rng(seed).normal(size=(TABLES, dim, bits)).astype(np.float32)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = unpacked(pdf["vec"].tolist())
            codes = np.stack([((x @ way > 0) @ (1 << np.arange(bits))) * len(ways) + t for t, way in enumerate(ways)], 1)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), len(ways)), "group": codes.astype(np.int64).reshape(-1)})

    patterns = nodes.mapInPandas(spread, "id long, group long").select("group", "id")
    dealt = nodes.select((-1 - F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(-(-n // DEALT) or 1))).alias("group"), "id")
    none = nodes.select("id", "vec", F.lit(float("-inf")).alias("least"))
    links = materialise(patterns.unionByName(dealt), files)
    graph = materialise(_merged(_offers(links, none, k, -1), k), files)
    discard(links)
    for turn in range(rounds):
        out = graph.select(F.col("id").alias("group"), F.explode("nbrs").alias("id"))
        links = materialise(out.unionByName(out.select(F.col("id").alias("group"), F.col("group").alias("id"))).distinct(), files)
        least = F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")).cast("double"))
        members = materialise(nodes.join(graph.select("id", least.alias("least")), "id"), files)
        now = materialise(_merged(graph.unionByName(_offers(links, members, PASSED, turn)), k), files)
        renewed = _renewed(graph, now)
        for old in (graph, links, members):
            discard(old)
        graph = now
        if renewed < RENEWED:
            break
    return graph


def _renewed(graph: DataFrame, now: DataFrame) -> float:
    """Share of the neighbours that a round brought in; similarities of near copies hardly move, their order does."""
    both = now.select("id", "nbrs").join(graph.select("id", F.col("nbrs").alias("was")), "id", "left")
    fresh = F.size(F.array_except("nbrs", F.coalesce("was", F.array().cast("array<bigint>"))))
    return both.agg(F.sum(fresh) / F.sum(F.size("nbrs"))).first()[0] or 0.0


def _walked(graph: DataFrame, nodes: DataFrame, n: int, files: int | None) -> DataFrame:
    """(id, nbrs, vecs): the best neighbours in both directions, and RANDOM others, with their vectors."""
    back = graph.select("id", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select(F.col("e.nbrs").alias("id"), F.array("id").alias("nbrs"), F.array("e.sims").alias("sims"))
    links = _merged(graph.unionByName(back), WALKED).select("id", F.explode("nbrs").alias("nbr"))
    for i in range(RANDOM):
        ring = Window.partitionBy(F.pmod(F.xxhash64("id", F.lit(100 + i)), F.lit(-(-n // 64) or 1))).orderBy(F.xxhash64("id", F.lit(200 + i)), "id")
        links = links.unionByName(nodes.select("id", F.lead("id").over(ring).alias("nbr")).where("nbr is not null"))
    pairs = links.join(nodes.select(F.col("id").alias("nbr"), "vec"), "nbr")
    return materialise(pairs.groupBy("id").agg(F.collect_list(F.struct("nbr", "vec")).alias("l")).select("id", F.col("l.nbr").alias("nbrs"), F.col("l.vec").alias("vecs")), files)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each list offers to the query that reads it."""
    for pdf in batches:
        if not len(pdf):
            continue
        count = np.array([len(x) for x in pdf["nbrs"]])
        ids, start = np.concatenate(pdf["nbrs"].tolist()), pdf["start"].to_numpy()
        owner = np.repeat(np.arange(len(pdf)), count)
        s = np.einsum("ij,ij->i", unpacked([v for vecs in pdf["vecs"] for v in vecs]), unpacked(pdf["vec"].tolist())[owner])
        ok = (s > pdf["least"].to_numpy()[owner]) & (ids != start[owner])
        if ok.any():
            yield _listed(*_best(start[owner[ok]], ids[ok], s[ok], BEAM))


def _advanced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Beams after a step, from the old beams and what was found, sorted by id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["old"].to_numpy(bool)]
        ids, nbrs, sims = _best(*_flat(pdf), BEAM)
        out = _listed(ids, nbrs, sims).merge(old[["id", "vec"]], on="id", how="right")
        known = dict(zip(old["id"], (set(n[np.asarray(f, bool)].tolist()) for n, f in zip(old["nbrs"], old["frontier"], strict=True)), strict=True))
        for name, none in (("nbrs", np.zeros(0, np.int64)), ("sims", np.zeros(0))):  # beams without any node
            out[name] = pd.Series([none if isinstance(x, float) else x for x in out[name]], dtype=object)
        out["done"] = pd.Series([[j in known[i] for j in x.tolist()] for i, x in zip(out["id"], out["nbrs"], strict=True)], dtype=object)
        return out[["id", "vec", "nbrs", "sims", "done"]]

    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = np.searchsorted(pdf["id"].to_numpy(), pdf["id"].iloc[-1])  # a query has STEP + 1 rows at most
        if last:
            yield run(pdf.iloc[:last])
        held = pdf.iloc[last:]
    if held is not None:
        yield run(held)


def walk(graph: DataFrame, nodes: DataFrame, starts: DataFrame, n: int, files: int | None = None) -> DataFrame:
    """Greedy search: (id, vec, nbrs, sims) with the beam of each start node; starts: (id)."""
    written = _walked(graph, nodes, n, files)
    lists = written.repartition("id").persist()
    none = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    begin = starts.join(nodes, "id").join(graph, "id", "left").select("id", "vec", F.coalesce("nbrs", none[0]).alias("nbrs"), F.coalesce("sims", none[1]).alias("sims"))
    state = materialise(begin.withColumn("done", F.transform("nbrs", lambda _: F.lit(False))), files)
    many = state.count() > SERVED
    over = lambda: F.forall("done", lambda d: d)
    finished = None
    while True:  # a step expands a node of every open beam for good, so beams end
        # the best unexpanded nodes of each beam, as places; beams are sorted by similarity
        open_ = F.filter(F.transform("done", lambda d, i: F.when(~d, i)), lambda i: i.isNotNull())
        todo = state.withColumn("open", F.slice(open_, 1, STEP))
        todo = todo.withColumn("frontier", F.transform("done", lambda d, i: d | F.array_contains("open", i)))
        least = F.when(F.size("sims") >= BEAM, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")).cast("double"))
        ahead = todo.select(F.col("id").alias("start"), "vec", least.alias("least"), F.explode(F.transform("open", lambda i: F.get("nbrs", i))).alias("id"))
        want, busy = ["start", "vec", "least", "nbrs", "vecs"], None
        if many:  # else no list can be wanted that often
            busy = ahead.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > SERVED)
            busy = materialise(busy.select("id", F.ceil(F.col("n") / SERVED).cast("int").alias("ways")))
        if busy is None or busy.isEmpty():
            read = lists.join(ahead.hint("shuffle_hash"), "id").select(want)
        else:
            read = lists.join(ahead.join(busy, "id", "left_anti").hint("shuffle_hash"), "id").select(want)
            dealt = lists.join(busy, "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
            asked = ahead.join(busy, "id").withColumn("salt", F.pmod(F.xxhash64("start"), "ways").cast("int")).drop("ways")
            read = read.unionByName(dealt.join(asked, ["id", "salt"]).select(want))
        found = read.mapInPandas(_scored, GRAPH)
        old = todo.select("id", "vec", "nbrs", "sims", "frontier", F.lit(True).alias("old"))
        both = old.unionByName(found.select("id", F.lit(None).cast("binary").alias("vec"), "nbrs", "sims", F.lit(None).cast("array<boolean>").alias("frontier"), F.lit(False).alias("old")))
        now = materialise(both.repartition("id").sortWithinPartitions("id").mapInPandas(_advanced, "id long, vec binary, nbrs array<long>, sims array<double>, done array<boolean>"), files)
        for old in (state, busy):
            if old is not None:
                discard(old)
        end = now.where(over()).select("id", "vec", "nbrs", "sims")
        finished = end if finished is None else finished.unionByName(end)
        state = materialise(now.where(~over()), files)
        if state.isEmpty():
            break
    lists.unpersist()
    discard(written)
    return finished


def exhaustive(some: DataFrame, nodes: DataFrame, n: int, k: int) -> DataFrame:
    """(id, nbrs, sims): the k best of all nodes for each of some (id, vec), block against block."""
    parts, asked = -(-n // EXACT_NODES), -(-some.count() // EXACT_QUERIES)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = some.select("id", "vec", deal("id", asked).alias("q"), each(parts).alias("b"))
    right = nodes.select("id", "vec", deal("id", parts).alias("b"), each(asked).alias("q"))

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _listed(*_flat(pd.DataFrame(columns=["id", "nbrs", "sims"])))
        s, ids = unpacked(a["vec"].tolist()) @ unpacked(b["vec"].tolist()).T, b["id"].to_numpy()
        s[a["id"].to_numpy()[:, None] == ids] = -np.inf
        top = np.argpartition(-s, min(k, len(ids)) - 1, axis=1)[:, :k]
        value = np.take_along_axis(s, top, 1)
        at, j = np.nonzero(value > -np.inf)
        return _listed(*_best(a["id"].to_numpy()[at], ids[top[at, j]], value[at, j], k))

    return _merged(left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(run, GRAPH), k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of each query.

    Queries are the rows whose vec_id is divisible by every; candidates are all rows but the
    query itself. Rows with a null vec_id, a null, zero or non-finite vector, or another length
    than most take no part; rows that repeat vec_id and vector count once. Every query gets
    k rows, or all candidates if there are fewer. Of equal vectors only the k + 1 smallest
    vec_ids can be among the k nearest, so a class keeps those.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 1000)
    files = files_for(vectors)
    rows = materialise(clean(vectors, vector).distinct(), files)
    classes = materialise(rows.groupBy("embedding").agg(F.min("vec_id").alias("id")), files)
    members = rows.join(classes, "embedding").select("vec_id", "id")
    first = members.withColumn("__at", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("__at") <= k + 1).select("id", "vec_id")
    first = materialise(first.groupBy("id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), files)
    queries = materialise(members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), files)

    dtype = np.float32 if classes.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": [packed(np.asarray(e, dtype)) for e in pdf["embedding"]]})

    nodes = materialise(classes.mapInPandas(pack, "id long, vec binary"), files)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    n = nodes.count()
    graph = build(nodes, n, dim, files)
    starts = queries.select(F.col("q").alias("id")).distinct()
    found = walk(graph, nodes, starts, n, files)
    short = materialise(found.where(F.size("nbrs") < min(k, n - 1)).select("id", "vec"))
    found = found.where(F.size("nbrs") >= min(k, n - 1)).select("id", "nbrs")
    if not short.isEmpty():
        found = found.unionByName(exhaustive(short, nodes, n, k).select("id", "nbrs"))
    # a query's own class is a candidate through its other members
    pairs = found.select(F.col("id").alias("q"), F.explode(F.array_union("nbrs", F.array("id"))).alias("id")).unionByName(starts.select(F.col("id").alias("q"), "id")).distinct()
    pairs = pairs.join(classes, "id").join(classes.select(F.col("id").alias("q"), F.col("embedding").alias("qe")), "q")
    dot = F.aggregate(F.zip_with("qe", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k + 1)
    near = pairs.select("q", "id", dot.alias("score")).groupBy("q").agg(best.alias("l")).select("q", F.explode("l").alias("e")).select("q", "e.less", "e.id")
    near = near.join(first, "id").select("q", "less", F.explode("ids").alias("vec_id"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("less", "vec_id"))), 1, k + 1)
    near = materialise(near.groupBy("q").agg(best.alias("l")), files)
    # queries of one class share its list, so a hot class costs no window
    own = F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(near, "q").select("query_id", F.posexplode(own).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.less")).alias("score"))
