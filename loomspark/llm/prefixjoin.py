"""N-gram Jaccard join by prefix trees of globally ordered sets.

1. Each text becomes the set of its hashed three-word shingles; equal sets are one class.
2. Only a set of which nearly all members occur in other sets can have a link. Every batch
   counts what its own sets share and sends the other members, packed, to buckets of hash values, where
   one sort counts distinct sets; what comes back is a number for each set, packed by batch. A member that half of all
   documents hold leaves each batch twice at most. False agreements of the 32 bits sent
   only let a set through.
3. The sets that stay are ordered by how rare their members are among them, then by hash. Of
   two linked sets the first members (all but percent of each) must meet: the prefix filter.
   Buckets of first members give stars, whose components are clusters.
4. A cluster (or a block of a large one, see clusters.py) becomes a compressed prefix tree. A set goes
   down all branches at once, in steps of PIECE members; the overlap of a shared path is
   counted once, and a branch ends where the members left on either side cannot reach the
   overlap that is asked for, where its sizes do not fit, or where all its sets are
   connected with this one already. A set that reaches a leaf has its exact overlap there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import clusters_of, settle
from .common import bound_batches, discard, files_for, materialise
from .neardup import set_key, text_key
from .textvec import shingle_set, words

WORDS_EACH = 3
PERCENT = 90
#: Bytes of input for a bucket of hash values (about a million shingles).
BUCKET_BYTES = 4 << 20
#: A plan that does not know its size says this or more.
UNKNOWN = 1 << 60
#: Members of a path that are compared in a step.
PIECE = 64
#: Bits of the hash below the rarity class.
HASH_BITS = 57


def set_of(text: str | None, k: int = WORDS_EACH) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    return shingle_set(words(data)[2], k)


# -- the tree --------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A compressed prefix tree over ascending rank arrays, as arrays over its nodes.

    Sets are in lexicographic order, so a node stands for a range lo..hi of them. The path
    into a node is elements start..end of flat. Node 0 is the root, its children are
    children[first[0]:first[1]]; leaf is a set or -1.
    """

    order: np.ndarray
    flat: np.ndarray
    start: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    children: np.ndarray


def tree(seqs: list[np.ndarray]) -> Tree:
    raw = [s.astype(">u4").tobytes() for s in seqs]
    order = np.array(sorted(range(len(seqs)), key=raw.__getitem__), np.int64)
    length = np.array([len(s) for s in seqs], np.int64)[order]
    flat = np.concatenate([seqs[i] for i in order]) if len(seqs) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    common = [0]  # members that a set shares with the one before it
    for i in range(1, len(order)):
        n = min(length[i - 1], length[i])
        differ = np.flatnonzero(flat[at[i - 1] : at[i - 1] + n] != flat[at[i] : at[i] + n])
        common.append(int(differ[0]) if len(differ) else int(n))
    common.append(0)
    # branch points: depth, first set, last set, parent
    depth, lo, hi, parent, leaf = [0], [0], [len(order)], [-1], [-1]
    open_ = [0]
    for i, n in enumerate(length.tolist()):
        while depth[open_[-1]] > common[i]:
            last = open_.pop()
            hi[last] = i
            if depth[open_[-1]] < common[i]:  # a new branch point above the one that ended
                depth.append(common[i]), lo.append(lo[last]), hi.append(0), parent.append(open_[-1]), leaf.append(-1)
                parent[last] = len(depth) - 1
                open_.append(len(depth) - 1)
        # the leaf of the set before hangs at the deeper of the points on both sides of it
        deep = max(common[i], common[i + 1])
        if depth[open_[-1]] < deep:
            depth.append(deep), lo.append(i), hi.append(0), parent.append(open_[-1]), leaf.append(-1)
            open_.append(len(depth) - 1)
        depth.append(n), lo.append(i), hi.append(i + 1), parent.append(open_[-1]), leaf.append(i)
    for x in open_[1:]:
        hi[x] = len(order)
    parent_, depth_ = np.array(parent), np.array(depth)
    up = np.where(parent_ >= 0, depth_[np.maximum(parent_, 0)], 0)
    base = at[np.array(lo)]
    kids = np.argsort(parent_, kind="stable")
    first = np.searchsorted(parent_[kids], np.arange(len(parent_) + 1))
    return Tree(order, flat, base + up, base + depth_, depth_, np.array(lo), np.array(hi), np.array(leaf), first, kids)


def _extremes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each range."""
    ends = np.stack([lo, hi], 1).ravel()
    return np.minimum.reduceat(np.append(values, values.max()), ends)[::2], np.maximum.reduceat(np.append(values, values.min()), ends)[::2]


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... of every range, one after the other."""
    total = np.concatenate([[0], np.cumsum(length)])
    return np.arange(total[-1]) + np.repeat(start - total[:-1], length)


def tree_links(seqs: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, centres: list[int], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of each centre to sets of other components, as positions, and the components then.

    seqs are ascending; sizes also count members that no other set has.
    """
    of, found = label.copy(), []
    if not len(seqs) or not any(len(s) for s in seqs):
        return found, of
    values, ranks = np.unique(np.concatenate(seqs), return_inverse=True)
    cuts = np.cumsum([len(s) for s in seqs])[:-1]
    seqs = np.split(ranks.astype(np.int64), cuts)
    t = tree(seqs)
    n = sizes[t.order]
    least, most = _extremes(n, t.lo, t.hi)
    longest = _extremes(np.array([len(seqs[i]) for i in t.order]), t.lo, t.hi)[1]
    marks = np.zeros(len(values), np.int8)
    for c in centres:
        mine, size = seqs[c], int(sizes[c])
        if not len(mine):
            continue
        marks[mine] = 1
        left = len(mine) - np.cumsum(marks)  # of this set beyond each rank
        turns = np.concatenate([[0], np.cumsum(np.diff(of[t.order]) != 0)])
        same = (turns[t.hi - 1] == turns[t.lo]) & (of[t.order][t.lo] == of[c])
        fits = ~same & (100 * most >= percent * size) & (100 * size >= percent * least)
        need = -(-percent * (size + np.maximum(least, -(-percent * size // 100))) // (100 + percent))
        node = t.children[t.first[0] : t.first[1]]
        node = node[fits[node]]
        at, overlap = t.start[node], np.zeros(len(node), np.int64)
        reached = []
        while len(node):
            stop = np.minimum(at + PIECE, t.end[node])
            length = stop - at
            hits = np.concatenate([[0], np.cumsum(marks[t.flat[_ragged(at, length)]], dtype=np.int64)])
            ends = np.cumsum(length)
            overlap = overlap + hits[ends] - hits[ends - length]
            depth = t.depth[node] - (t.end[node] - stop)
            beyond = np.where(depth > 0, left[t.flat[np.maximum(stop - 1, 0)]], len(mine))
            alive = overlap + np.minimum(beyond, longest[node] - depth) >= need[node]
            node, at, overlap = node[alive], stop[alive], overlap[alive]
            done = at == t.end[node]
            leaf = done & (t.leaf[node] >= 0)
            reached.append(np.stack([t.leaf[node[leaf]], overlap[leaf]]))
            inner = np.flatnonzero(done & ~leaf)
            count = t.first[node[inner] + 1] - t.first[node[inner]]
            kids = t.children[_ragged(t.first[node[inner]], count)]
            kept = fits[kids]
            kid_at, kid_overlap = t.start[kids][kept], np.repeat(overlap[inner], count)[kept]
            go = ~done
            node, at, overlap = np.concatenate([node[go], kids[kept]]), np.concatenate([at[go], kid_at]), np.concatenate([overlap[go], kid_overlap])
        marks[mine] = 0
        for i, both in np.concatenate(reached, 1).T.tolist() if reached else ():
            other = int(t.order[i])
            if of[other] != of[c] and (100 + percent) * both >= percent * (size + int(n[i])):
                of[of == of[other]] = of[c]
                found.append((c, other))
    return found, of


# -- the join --------------------------------------------------------------------------------------------------


def _packed(keys: np.ndarray, owner: np.ndarray, low: np.ndarray) -> bytes:
    """Owners as runs (count, keys, lengths), then the 32 bits of each member."""
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    runs = np.diff(np.append(cut, len(owner))).astype(np.uint32)
    return np.uint32(len(cut)).tobytes() + keys[owner[cut]].tobytes() + runs.tobytes() + low.astype(np.uint32).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.frombuffer(data, np.uint64, n, 4), np.frombuffer(data, np.uint32, n, 4 + 8 * n), np.frombuffer(data, np.uint32, -1, 4 + 12 * n)


def sketch(docs: DataFrame, buckets: int, k: int, text: str = "text") -> DataFrame:
    """Rows of documents (bucket null) and rows of packed members (the others); no shuffle.

    A document row has doc_id, text_key, n, set_key, key (its first 8 bytes), batch and own: members that are shared
    with another set of its batch. A packed row has what one batch sends to one bucket; with ask, its owners want to hear.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 32
        for batch, pdf in enumerate(batches, task):
            sets = [set_of(t, k) for t in pdf["t"]]
            names = [set_key(s) if len(s) else None for s in sets]
            known = pdf["doc_id"].notna().to_numpy()
            first: dict[bytes, int] = {}
            for i, x in enumerate(names):
                if x is not None and known[i]:
                    first.setdefault(x, i)
            distinct = [sets[i] for i in first.values()]
            keys = np.array([int.from_bytes(x[:8], "little") for x in first], np.uint64)
            own = np.zeros(len(distinct), np.int64)
            rows: list[tuple[int, bool, bytes]] = []
            if distinct:
                grams, owner = np.concatenate(distinct), np.repeat(np.arange(len(distinct)), [len(s) for s in distinct])
                by = np.argsort(grams, kind="stable")
                new = np.concatenate([[True], grams[by][1:] != grams[by][:-1]])
                run_at = np.flatnonzero(new)
                count = np.diff(np.append(run_at, len(by)))
                several = np.repeat(count > 1, count)
                own = np.bincount(owner[by[several]], minlength=len(distinct))
                two = np.zeros(len(by), bool)
                two[run_at[count > 1]] = two[run_at[count > 1] + 1] = True
                for ask, chosen in ((True, by[~several]), (False, by[two])):
                    if not len(chosen):
                        continue
                    chosen = np.sort(chosen)  # by owner, so that its runs are long
                    to = ((grams[chosen] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    sent = np.argsort(to, kind="stable")
                    at = np.flatnonzero(np.diff(to[sent], prepend=-1))
                    for s, e in zip(at, np.append(at[1:], len(sent)), strict=True):
                        x = chosen[sent[s:e]]
                        rows.append((int(to[sent[s]]), ask, _packed(keys, owner[x], grams[x] & np.uint64(0xFFFFFFFF))))
            shared = dict(zip(first, own.tolist(), strict=True))
            n = len(pdf)
            signed = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in names]
            yield pd.DataFrame({"bucket": pd.array([None] * n, "Int32"), "ask": None, "packed": None, "batch": batch, "doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n": np.array([len(s) for s in sets], np.int64), "set_key": names, "key": pd.array(signed, "Int64"), "own": [shared.get(x, 0) for x in names]})
            if rows:
                b, a, p = zip(*rows, strict=True)
                yield pd.DataFrame({"bucket": pd.array(b, "Int32"), "ask": a, "packed": p, "batch": batch, "doc_id": pd.array([None] * len(b), "Int64"), "text_key": None, "n": 0, "set_key": None, "key": pd.array([None] * len(b), "Int64"), "own": 0})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "bucket int, ask boolean, packed binary, batch long, doc_id long, text_key string, n long, set_key binary, key long, own long")


def _answers(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each batch, how many of the members that its sets asked about occur in another set too: keys, then counts."""
    keys, runs, low = zip(*(_unpacked(x) for x in rows["packed"]), strict=True)
    ends = np.cumsum([len(k) for k in keys])
    keys, low = np.concatenate(keys), np.concatenate(low)
    run = np.repeat(np.arange(len(keys), dtype=np.int32), np.concatenate(runs))
    by = np.argsort(low, kind="stable")
    low, run = low[by], run[by]
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    owner = keys[run]
    several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
    told = np.bincount(run[np.repeat(several, np.diff(np.append(at, len(low))))], minlength=len(keys)).astype(np.int32)
    out = []
    for batch, ask, end, n in zip(rows["batch"], rows["ask"], ends, np.diff(ends, prepend=0), strict=True):
        some = np.flatnonzero(told[end - n : end]) + (end - n)
        if ask and len(some):
            out.append((batch, keys[some].tobytes() + told[some].tobytes()))
    return pd.DataFrame(out, columns=["batch", "answers"])


def _heard(batch: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The answers to one batch, added up: one row for each of its sets."""
    data = [np.frombuffer(x, np.uint8) for x in rows["answers"]]
    keys, at = np.unique(np.concatenate([x[: len(x) // 3 * 2].view(np.int64) for x in data]), return_inverse=True)
    n = np.bincount(at, np.concatenate([x[len(x) // 3 * 2 :].view(np.int32) for x in data]), len(keys))
    return pd.DataFrame({"batch": batch[0], "key": keys, "told": n.astype(np.int64)})


def candidates(docs: DataFrame, percent: int, k: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n, set_key of every row; id, set_key, doc, text_key, n, shared of every distinct set."""
    spark, files = docs.sparkSession, files_for(docs)
    bound_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] // 2
    buckets = min(1 << 20, max(2 * spark.sparkContext.defaultParallelism, size // BUCKET_BYTES))
    done = materialise(sketch(docs, buckets, k, text), 0)
    rows = done.where("bucket is null").select("batch", "doc_id", "text_key", "n", "set_key", "key", "own")
    told = done.where("bucket is not null").select("bucket", "ask", "packed", "batch").groupBy("bucket").applyInPandas(_answers, "batch long, answers binary")
    told = told.groupBy("batch").applyInPandas(_heard, "batch long, key long, told long")  # a batch's own members bound its answers
    heard = rows.where("set_key is not null and doc_id is not null").join(told, ["batch", "key"], "left")
    shared = F.max(F.col("own") + F.coalesce("told", F.lit(0))).alias("shared")
    classes = heard.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n").alias("n"), shared)
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("row.doc_id").alias("doc"), F.col("row.text_key").alias("text_key"), "n", "shared")
    return rows.select("doc_id", "n", "set_key"), materialise(classes, files)


def ordered_sets(docs: DataFrame, stay: DataFrame, k: int, files: int, text: str = "text") -> DataFrame:
    """id, n and codes of every set that stays: members that another one has too, rare ones first.

    A code is the logarithm of the number of sets that have the member, then bits of its hash,
    so the order of codes is the order of the tree.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "grams": [set_of(t, k).view(np.int64) for t in pdf["t"]]})

    found = docs.select(F.col("doc_id").cast("long").alias("doc"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    found = found.join(stay.select("id", "doc", "text_key", "n"), ["doc", "text_key"]).groupBy("id").agg(F.first("n").alias("n"), F.first("t").alias("t"))
    sets = materialise(found.mapInPandas(run, "id long, n long, grams array<long>"), 0)
    members = sets.select("id", F.explode("grams").alias("gram"))
    often = materialise(members.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1"), files)
    code = F.shiftleft(F.floor(F.log2("sets")).cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.col("gram"), 64 - HASH_BITS))
    coded = members.join(often, "gram").select("id", code.alias("code")).groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    out = materialise(coded.join(sets.select("id", "n"), "id").select("id", F.col("n").alias("size"), "codes"), files)
    discard(sets)
    discard(often)
    return out


def jaccard_join(docs: DataFrame, percent: int = PERCENT, k: int = WORDS_EACH, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    component_id is the least doc_id among all rows that links (100 * intersection >= percent *
    union of the sets of k-word shingles) lead to. A null text or one without words has an empty
    set and stands alone; fewer than k words are one shingle. Rows without doc_id have no component (null) and
    link nothing. Rows that repeat a doc_id are judged one by one; equal rows get equal results. An empty
    table gives an empty result; other columns are not read.
    """
    files = files_for(docs)
    rows, classes = candidates(docs, percent, k, text)
    stay = classes.where(100 * F.col("shared") >= percent * F.col("n"))
    sets = ordered_sets(docs, stay, k, files, text)
    unique = F.col("size") - F.size("codes")
    first = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1 - unique
    prefix = sets.where(first > 0).select("id", F.explode(F.slice("codes", 1, first.cast("int"))).alias("code"))
    buckets = materialise(prefix.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), files)
    stars = materialise(prefix.join(buckets, "code").groupBy("id", "least").agg(F.sum("n").alias("weight")), files)
    clusters = clusters_of(stars, sets.select("id", (8 * F.size("codes")).alias("bytes")), files)

    def compare(g: pd.DataFrame, label: np.ndarray, centres: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        return tree_links([np.asarray(x, np.int64) for x in g["codes"]], g["size"].to_numpy(), label, centres, percent)

    members = materialise(clusters.join(sets, "id"), files)
    found = settle(members, ["size", "codes"], compare, files)
    named = classes.select("id", "set_key", "doc").join(found, "id", "left").select("set_key", "doc", F.coalesce("component", "id").alias("component"))
    named = materialise(named, files)
    for old in (sets, buckets, stars, clusters, members):
        discard(old)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = materialise(named.join(least, "component").select("set_key", "component_id"), files)
    out = rows.join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


#: The same in DuckDB, with all pairs that share a shingle and the closure of their links.
SQL = """
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) end) as s from docs),
flat as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as i, b.doc_id as j, count(*) as n from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select i, j from pairs join sets x on x.doc_id = i join sets y on y.doc_id = j where 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
ways as (select i, j from links union all select j, i from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, w.j from reach r join ways w on r.b = w.i)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""
