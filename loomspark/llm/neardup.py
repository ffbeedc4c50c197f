"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact checks.

1. Each text becomes the set of its hashed five-word shingles. A register keeps, for one
   hash function, the leading zeros of the least hash and ten bits after them.
2. Equal sets fall into one class with a number of its own; from here on only classes count.
3. Bands of registers collect classes; each band bucket gives a star to its least member,
   never its pairs. Connected components of the stars are clusters; a true link lies
   inside a cluster unless all bands miss it (bands_for keeps that below MISSED at the threshold; < 1e-6 at 0.85).
4. Inside a cluster, centres are compared with all members that are not yet connected to
   them (clusters.py): the collision-corrected estimate from registers first, then the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import clusters_of, settle
from .common import bound_batches, discard, files_for, materialise
from .textvec import shingle_set, words

REGISTERS = 80
#: Registers in a band, widest first, and the share of links at the threshold that all bands together may miss.
ROWS, MISSED = (4, 2, 1), 5e-5
MANTISSA = 10
#: Estimates this far below the threshold are not checked on full sets: six standard errors and more.
SLACK = 0.25
#: Odd multipliers of the register hash functions, from a fixed generator.
MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = np.random.default_rng(21).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2)


def set_of(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    return shingle_set(words(data)[2])


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values (64 for 0)."""
    n = np.zeros(x.shape, np.uint64)
    for shift in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1 << (64 - shift))
        n += np.where(low, np.uint64(shift), np.uint64(0))
        x = np.where(low, x << np.uint64(shift), x)
    return np.where(x == 0, np.uint64(64), n)


def registers(s: np.ndarray) -> np.ndarray:
    """16-bit registers of a non-empty set: leading zeros of the least hash, then mantissa bits."""
    least = np.empty(REGISTERS, np.uint64)
    for at in range(0, REGISTERS, 8):
        least[at : at + 8] = (s[:, None] * MULTIPLIERS[at : at + 8] + ADDENDS[at : at + 8]).min(0) if len(s) < 64 else [(s * m + a).min() for m, a in zip(MULTIPLIERS[at : at + 8], ADDENDS[at : at + 8], strict=True)]
    zeros = np.minimum(leading_zeros(least), np.uint64(62))
    after = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | after).astype(np.uint16)


@lru_cache(maxsize=4096)
def _chance(a: int, b: int) -> float:
    """Probability that registers of disjoint sets of about 2**(a/2) and 2**(b/2) members agree."""
    n, m, total = 2 ** (a / 2), 2 ** (b / 2), 0.0
    part = np.arange(1 << MANTISSA)
    for z in range(40):
        low = (1 + part / (1 << MANTISSA)) * 2.0 ** -(z + 1)
        high = low + 2.0 ** -(z + 1 + MANTISSA)

        def hits(k: float, low: np.ndarray = low, high: np.ndarray = high) -> np.ndarray:
            return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-15)))

        total += float((hits(n) * hits(m)).sum())
    return total


def estimate(agree: float, n: int, m: int) -> float:
    """Collision-corrected Jaccard estimate from the share of agreeing registers."""
    chance = _chance(*sorted((round(2 * math.log2(n)), round(2 * math.log2(m)))))
    return (agree - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _compare(regs: np.ndarray, sets: list[np.ndarray], label: list, centres: list[int], percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of each centre to members of other components, as positions, and the components then.

    label names the component of each member so far; a link found here joins two of them, so
    that later centres skip what is already connected.
    """
    sizes = np.array([len(s) for s in sets])
    of = np.unique(np.asarray(label), return_inverse=True)[1]
    found = []
    for c in centres:
        others = np.flatnonzero(of != of[c])
        others = others[100 * np.minimum(sizes[others], sizes[c]) >= percent * np.maximum(sizes[others], sizes[c])]
        if not len(others):
            continue
        agree = (regs[others] == regs[c]).mean(1)
        near = agree >= percent / 100 - SLACK  # the correction only lowers a share
        for i, share in zip(others[near].tolist(), agree[near].tolist(), strict=True):
            if of[i] == of[c]:
                continue
            if estimate(share, int(sizes[c]), int(sizes[i])) >= percent / 100 - SLACK and linked(sets[c], sets[i], percent):
                of[of == of[i]] = of[c]
                found.append((c, i))
    return found, of


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and registers in each, as wide as MISSED allows for links at the threshold."""
    for rows in ROWS:
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISSED:
            return REGISTERS // rows, rows
    raise ValueError(f"{REGISTERS} registers cannot find links at {percent} percent")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null without words) and registers of every row; no shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, keys, regs = [], [], []
            for t in pdf["t"]:
                s = set_of(t)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_shingles": np.array(n, np.int64), "set_key": keys, "regs": regs})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "doc_id long, text_key string, n_shingles long, set_key binary, regs binary")


def near_classes(docs: DataFrame, percent: int = 85, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): sketch() of every row, and set_key, doc (least doc_id), component of each distinct set.

    Sets that occur only without a doc_id have no class. Classes are numbered, so two texts
    under one doc_id are two classes, and the component is the least number of its classes.
    """
    n_bands, rows = bands_for(percent)
    files = files_for(docs)
    keep = partial(materialise, files=files)
    done = materialise(sketch(docs, text), 0)  # one task for each piece that is read
    whole = done.where("set_key is not null and doc_id is not null")
    # one row stands for the class; the number is fixed once it is written
    classes = whole.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n_shingles"))
    classes = keep(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("row.doc_id").alias("doc"), F.col("row.text_key").alias("text_key"), "regs", "n_shingles"))

    width = 2 * rows
    bands = classes.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.substring(F.col("regs"), i * width + 1, F.lit(width)))).alias("band", "part"))
    bands = bands.select("id", F.xxhash64("part", "band").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = keep(bands.join(buckets, "key").groupBy("id", "least").agg(F.sum("n").alias("weight")))
    members = clusters_of(stars, classes.select("id", (8 * F.col("n_shingles")).alias("bytes")), files)
    members = keep(members.join(classes.select("id", "doc", "text_key", "regs"), "id"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            new = np.ones(len(ids), bool)
            if len(ids):  # repeated rows stand together: one is enough
                new[1:] = ids[1:] != ids[:-1]
                new[0] = ids[0] != last
                last = ids[-1]
            pdf = pdf[new]
            pdf["hashes"] = [set_of(t).tobytes() for t in pdf.pop("t")]
            yield pdf

    with_text = docs.select(F.col("doc_id").cast("long").alias("doc"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("t")).join(members, ["doc", "text_key"])
    columns = ["id", "cluster", "weight", "n", "blocks", "regs", "t"]
    # as many tasks as the join has: merged partitions of whole texts come out uneven
    sets = materialise(with_text.select(columns).mapInPandas(hashes, "id long, cluster long, weight long, n long, blocks int, regs binary, hashes binary"), 0)
    for old in (stars, members):
        discard(old)

    def compare(g: pd.DataFrame, label: np.ndarray, centres: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
        regs = np.stack([np.frombuffer(r, np.uint16) for r in g["regs"]])
        return _compare(regs, [np.frombuffer(s, np.uint64) for s in g["hashes"]], label, centres, percent)

    found = settle(sets, ["regs", "hashes"], compare, files)
    named = keep(classes.select("id", "set_key", "doc").join(found, "id", "left").select("set_key", "doc", F.coalesce("component", "id").alias("component")))
    discard(sets)
    return done, named


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the least doc_id among all rows that links (100 * intersection >=
    percent * union of shingle sets) lead to. A null text or one without words has an empty set
    and stands alone. Rows with a null doc_id have no component (null) and are kept. Rows
    that repeat a doc_id are judged one by one; equal rows get equal results.
    """
    done, named = near_classes(docs, percent, text)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = materialise(named.join(least, "component").select("set_key", "component_id"), files_for(docs))
    out = done.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, whole, with all its columns.

    The one with the least doc_id stays (of texts under one doc_id, the one with the least md5).
    Rows that repeat both doc_id and text are one document and come out once. Texts without
    words are linked with nothing; rows without doc_id have no component, and all stay.
    """
    done, named = near_classes(docs, percent, text)
    row = F.struct("doc_id", "text_key")
    linked = done.where("doc_id is not null").join(named.select("set_key", "component"), "set_key")
    stay = linked.groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key")
    empty = done.where("doc_id is not null and set_key is null").select("doc_id", "text_key")
    stay = materialise(stay.unionByName(empty).distinct(), files_for(docs)).withColumnsRenamed({"doc_id": "__doc", "text_key": "__key"})
    # columns of docs may have any name, so they travel inside a struct
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__doc"), text_key(F.col(text)).alias("__key"), F.struct(docs.columns).alias("__row"))
    # rows that repeat merge before the shuffle; should other columns differ, the least row stays
    once = whole.groupBy("__doc", "__key").agg(F.min("__row").alias("__row"))
    return once.join(stay, ["__doc", "__key"], "left_semi").select("__row.*").unionByName(docs.where("doc_id is null"))


#: The same in DuckDB, with all pairs that share a shingle and the closure of their links.
SQL = """
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from docs),
flat as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as i, b.doc_id as j, count(*) as n from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select i, j from pairs join sets x on x.doc_id = i join sets y on y.doc_id = j where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
ways as (select i, j from links union all select j, i from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, w.j from reach r join ways w on r.b = w.i)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id, min(r.b) = s.doc_id as kept from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""
