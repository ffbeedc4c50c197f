"""Repeated passages by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the least of its M-word grams under a
fixed order, so equal windows have equal minimisers. Consecutive windows that share one
travel together as one packed string (a super-k-mer) to the bucket of the minimiser; there all
windows of the bucket are hashed, sorted, and equal neighbours compared byte by byte. So
windows are counted exactly, and text travels about (K + run) / run times instead of K.

Skew: grams that hold more than a SHARE of all grams go last in the order, so a very common
line, passage or word pair is a minimiser only where a window has nothing rarer. The list
of such grams has at most 2 / SHARE entries by construction. Rows that repeat within one
Arrow batch are read once, and equal super-k-mers of a batch are merged before the shuffle: one
copy travels, marked as repeated, and the other places are sent on as bare intervals. What is
left for one minimiser is at most a SHARE of all grams; a bucket that is larger than HELD
is counted in several passes over its packed strings, each for a part of the window hashes,
so that a worker holds the packed bytes and one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, files_for, materialise
from .textvec import batches, grams, words

K, M = 35, 4
#: A gram with more than this share of all grams is common.
SHARE = 1 / 50_000
#: Longest run of windows in one super-k-mer, and words of text aimed at for one bucket.
RUN, BUCKET_WORDS = 512, 20_000
#: Bytes of packed strings that are counted in one go; whole buckets are added up to it.
CHUNK = 4 << 20
#: Bytes of unpacked strings of one bucket that are counted in one pass.
HELD = 64 << 20
COMMON = np.uint64(1 << 63)
#: Packed strings are compressed with a shared dictionary of so many bytes, trained on the start of a few texts.
#: It only makes small blobs smaller; results do not depend on it.
DICTIONARY, DICTIONARY_TEXTS, DICTIONARY_CHARS = 32 << 10, 500, 8000
LEVEL = 9


def _laid(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one byte string: (bytes, word starts, word ends, word hashes, text of each word)."""
    data = b"\n".join(texts) + b"\n"
    start, end, h = words(data)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return data, start, end, h, np.searchsorted(first, start, side="right") - 1


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    p = 1
    while p * 2 <= w:
        v = np.minimum(v[:-p], v[p:])
        p *= 2
    return np.minimum(v[: len(v) - (w - p)], v[w - p :]) if w > p else v


def _runs(h: np.ndarray, of: np.ndarray, common: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(h) < k:
        return none, none, none.astype(np.uint64)
    g = grams(h, m) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        g = np.where(common[at] == g, g | COMMON, g)
    least = _least(g, k - m + 1)
    valid = of[: len(least)] == of[k - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(least)))
    # windows that cross into the next text end every run
    inside = np.add.reduceat(valid.astype(np.int64), first)
    n = np.minimum(n, inside)
    first, n = first[n > 0], n[n > 0]
    if len(n) and n.max() > RUN:
        pieces = -(-n // RUN)
        base = np.repeat(first, pieces)
        step = (np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        n = np.minimum(np.repeat(n, pieces) - step, RUN)
        first = base + step
    return first, n, least[first]


def _normal(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words joined by single spaces, and where each word starts there."""
    raw = np.frombuffer(data, np.uint8)
    keep = np.zeros(len(raw), bool)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = np.where(keep, raw, np.uint8(32))
    keep[end] = True  # every text ends with a separator
    size = end - start + 1
    return out[keep].tobytes(), np.cumsum(size) - size


def _pack(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, n: np.ndarray, multi: np.ndarray, strings: list[bytes], squeeze: zstandard.ZstdCompressor) -> bytes:
    head = np.array([len(ids)], np.int64).tobytes()
    return squeeze.compress(head + ids.astype(np.int64).tobytes() + starts.astype(np.int64).tobytes() + keys.astype(np.int64).tobytes() + n.astype(np.int32).tobytes() + multi.astype(np.uint8).tobytes() + b"\n".join(strings))


def _unpack(blob: bytes, open_: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = open_.decompress(blob)
    c = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.int64, np.int64, np.int32, np.uint8):
        out.append(np.frombuffer(raw, kind, c, at))
        at += c * np.dtype(kind).itemsize
    ids, starts, keys, n, multi = out
    return ids, keys, starts, n, multi, raw[at:].split(b"\n")


def common_grams(rows: DataFrame, m: int = M) -> tuple[int, np.ndarray]:
    """Words of the table, and the sorted hashes (less one bit) of its common grams.

    Each batch names the grams that hold half a SHARE of it; a gram with a whole SHARE of all
    must be among them somewhere. The list only balances load, so a sum that misses a
    batch does no harm.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in batches(texts):
                _, _, _, h, of = _laid(texts[a:b])
                found, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(h) >= m:
                    g = grams(h, m)[of[: len(h) - m + 1] == of[m - 1 :]] >> np.uint64(1)
                    found, n = np.unique(g, return_counts=True)
                    many = n >= max(3, SHARE / 2 * n.sum())
                    found, n = found[many], n[many]
                yield pd.DataFrame({"gram": np.append(found.astype(np.int64), -1), "n": np.append(n, len(h))})

    sums = rows.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = materialise(sums)
    total = sums.where("gram = -1").first()
    total = total["n"] if total else 0
    top = sums.where((F.col("gram") >= 0) & (F.col("n") >= SHARE * total)).orderBy(F.desc("n"), "gram").limit(int(2 / SHARE)).collect()
    return total, np.sort(np.array([r["gram"] for r in top], np.uint64))


def shared_dictionary(rows: DataFrame) -> bytes:
    """A compression dictionary for packed strings; empty if the table is too small to train one."""
    some = [r["t"].encode("utf-8", "surrogatepass") for r in rows.select(F.left("text", F.lit(DICTIONARY_CHARS)).alias("t")).where("t is not null").limit(DICTIONARY_TEXTS).collect()]
    pieces = [t[i : i + 400] for t in some for i in range(0, len(t), 400)]
    if len(pieces) < 200:
        return b""
    return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()


def _codec(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def super_kmers(rows: DataFrame, total: int, common: np.ndarray, k: int = K, m: int = M, dictionary: bytes = b"") -> DataFrame:
    """(bucket, blob) rows from (id, key, text): packed super-k-mers of one batch and bucket.

    (id, key) names a row; rows that share it must have equal texts.
    """
    buckets = max(1, total // BUCKET_WORDS)
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(dictionary))
        for pdf in parts:
            copies = pdf.duplicated(["id", "key"], keep=False).to_numpy()
            once = ~pdf.duplicated(["id", "key"]).to_numpy()
            pdf, copies = pdf[once], copies[once]  # equal rows lose the same words
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            ids, keys = pdf["id"].to_numpy(), pdf["key"].to_numpy()
            where: dict[bytes, int] = {}
            rid, rkey, rstart, rn, rbucket, multi, strings = [], [], [], [], [], [], []
            for a, b in batches(texts):
                data, start, end, h, of = _laid(texts[a:b])
                first, n, least = _runs(h, of, sent.value, k, m)
                if not len(first):
                    continue
                normal, place = _normal(data, start, end)
                last = first + n + k - 2
                lo, hi = place[first].tolist(), (place[last] + (end - start)[last]).tolist()
                begins = np.searchsorted(of, np.arange(b - a))
                doc = of[first]
                base = len(strings)
                for i, (s, e, again) in enumerate(zip(lo, hi, copies[a:b][doc].tolist(), strict=True)):
                    string = normal[s:e]
                    before = where.setdefault(string, base + i)
                    if before == base + i:
                        strings.append(string)
                        multi.append(int(again))
                    else:
                        multi[before] = 1
                        strings.append(b"")
                        multi.append(1)
                rid.append(ids[a:b][doc])
                rkey.append(keys[a:b][doc])
                rstart.append(first - begins[doc])
                rn.append(n)
                rbucket.append((least % np.uint64(buckets)).astype(np.int64))
            if not strings:
                continue
            rid, rkey, rstart, rn, rbucket = map(np.concatenate, (rid, rkey, rstart, rn, rbucket))
            multi = np.array(multi, np.uint8)
            bare = np.array([not s for s in strings])
            rbucket[bare] = (rid[bare] * 31 + rkey[bare]) % buckets  # bare intervals may go anywhere
            order = np.argsort(rbucket, kind="stable")
            cut = np.flatnonzero(np.diff(rbucket[order])) + 1
            out_bucket, out_blob = [], []
            for part in np.split(order, cut):
                out_bucket.append(int(rbucket[part[0]]))
                out_blob.append(_pack(rid[part], rkey[part], rstart[part], rn[part], multi[part], [strings[i] for i in part.tolist()], squeeze))
            yield pd.DataFrame({"bucket": out_bucket, "blob": out_blob})

    return rows.mapInPandas(run, "bucket long, blob binary")


def _count(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, n: np.ndarray, multi: np.ndarray, strings: list[bytes], k: int, part: tuple[int, int] = (0, 1)) -> pd.DataFrame:
    """Intervals of repeated windows among whole buckets; part (i, p): of the windows whose hash is i modulo p."""
    known = multi.astype(bool)
    # equal super-k-mers first: all their windows repeat, and one of them stands for all
    first: dict[bytes, int] = {}
    alone = []
    for i, s in enumerate(strings):
        if s:
            at = first.setdefault(s, i)
            if at == i:
                alone.append(i)
            else:
                known[i] = known[at] = True
    out = [(ids[known], keys[known], starts[known], n[known])]
    texts = [strings[i] for i in alone]
    if texts:
        data, begin, end, h, of = _laid(texts)
        g = grams(h, k)
        places = np.flatnonzero((of[: len(g)] == of[k - 1 :]) & (g % np.uint64(part[1]) == part[0]))
        g = g[places]
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        same = np.flatnonzero(sorted_g[1:] == sorted_g[:-1])
        hit = np.zeros(len(of), bool)
        at = places[order]
        left, right = at[same], at[same + 1]
        lo_a, hi_a, lo_b, hi_b = (x.tolist() for x in (begin[left], end[left + k - 1], begin[right], end[right + k - 1]))
        equal = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in zip(lo_a, hi_a, lo_b, hi_b, strict=True)), bool, len(same))
        hit[left[equal]] = hit[right[equal]] = True
        for value in np.unique(sorted_g[same[~equal]]):  # different windows with one hash: count them as strings
            seen: dict[bytes, int] = {}
            for w in at[sorted_g == value].tolist():
                other = seen.setdefault(data[begin[w] : end[w + k - 1]], w)
                if other != w:
                    hit[w] = hit[other] = True
        hit[np.flatnonzero(known[alone][of])] = False  # whole super-k-mers are out already
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        run = np.array(alone)[of[s]] if len(s) else np.zeros(0, np.int64)
        offset = s - np.searchsorted(of, of[s]) if len(s) else s
        out.append((ids[run], keys[run], starts[run] + offset, e - s))
    ids, keys, starts, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"id": ids, "key": keys, "start": starts, "n": n.astype(np.int64)})


def repeated_windows(rows: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(id, key, start, n): runs of n repeated windows from word number start of a text."""
    total, common = common_grams(rows, m)
    dictionary = shared_dictionary(rows)
    sent = super_kmers(rows, total, common, k, m, dictionary)
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))
        held: list[bytes] = []
        size, last = 0, None

        def flush() -> Iterator[pd.DataFrame]:
            if size <= HELD:
                *arrays, strings = zip(*(_unpack(b, open_) for b in held), strict=True)
                yield _count(*map(np.concatenate, arrays), [s for x in strings for s in x], k)
            else:
                passes = -(-size // HELD)
                for i in range(passes):
                    yield from _counted_part(held, open_, k, (i, passes))

        for pdf in parts:
            for bucket, blob in zip(pdf["bucket"], pdf["blob"], strict=True):
                if held and bucket != last and size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
                last = bucket
                held.append(blob)
                size += zstandard.frame_content_size(blob)
        if held:
            yield from flush()

    return ordered.mapInPandas(run, "id long, key long, start long, n long")


def _counted_part(blobs: list[bytes], open_: zstandard.ZstdDecompressor, k: int, part: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Like _count() over all blobs, for one part of the window hashes: each blob is cut to its windows of that part first."""
    cut: list[tuple] = []
    for blob in blobs:
        ids, keys, starts, n, multi, strings = _unpack(blob, open_)
        bare = np.array([not s for s in strings])
        if part[0] == 0 and bare.any():
            yield pd.DataFrame({"id": ids[bare], "key": keys[bare], "start": starts[bare], "n": n[bare].astype(np.int64)})
        full = np.flatnonzero(~bare)
        if not len(full):
            continue
        data, begin, end, h, of = _laid([strings[i] for i in full])
        g = grams(h, k)
        at = np.flatnonzero((of[: len(g)] == of[k - 1 :]) & (g % np.uint64(part[1]) == part[0]))
        row = full[of[at]]
        offset = at - np.searchsorted(of, of[at])
        cut.append((ids[row], keys[row], starts[row] + offset, np.ones(len(at), np.int32), multi[row], [data[s:e] for s, e in zip(begin[at].tolist(), end[at + k - 1].tolist(), strict=True)]))
    if cut:
        *arrays, strings = zip(*cut, strict=True)
        yield _count(*map(np.concatenate, arrays), [s for x in strings for s in x], k)


def remove_repeats(docs: DataFrame, text: str = "text", k: int = K, m: int = M, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with_text adds the kept text.

    A word goes if a window over it has a word sequence that starts anywhere else, in another
    row or the same one. A null text has no words; texts with fewer than k words keep all.
    Rows that repeat a document are documents of their own, so their long texts go. Null
    doc_ids are allowed: a row is known by 120 bits of the md5 of its doc_id and text, and equal
    rows lose the same words.
    """
    bound_batches(docs.sparkSession)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), half(1).alias("id"), half(17).alias("key"), F.col(text).alias("text"))
    found = repeated_windows(rows.select("id", "key", "text"), k, m)
    # a set: equal rows name the same intervals; written, so that AQE may split a row with very many copies in the join
    found = materialise(found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("s")), files_for(docs))
    joined = rows.join(found, ["id", "key"], "left").select("doc_id", "text", F.col("s.start").alias("starts"), F.col("s.n").alias("ns"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            n_words, n_gone, sha, kept_texts = [], [], [], []
            for t, starts, ns in zip(pdf["text"], pdf["starts"], pdf["ns"], strict=True):
                parts_ = (t or "").encode("utf-8", "surrogatepass").split()
                kept = parts_
                if starts is not None:
                    edge = np.zeros(len(parts_) + 1, np.int32)
                    starts, ns = np.asarray(starts, np.int64), np.asarray(ns, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + ns + (k - 1), -1)
                    kept = [parts_[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                whole = b" ".join(kept)
                n_words.append(len(parts_))
                n_gone.append(len(parts_) - len(kept))
                sha.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept_texts.append(whole.decode("utf-8", "surrogatepass"))
            out = {"doc_id": pdf["doc_id"].astype("Int64"), "n_words": np.array(n_words, np.int64), "n_removed": np.array(n_gone, np.int64), "kept_sha256": sha}
            yield pd.DataFrame(out | ({"kept_text": kept_texts} if with_text else {}))

    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


#: The same in DuckDB, by comparing the word sequences of all windows.
SQL = f"""
with docs as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select r, i, md5(array_to_string(w[i : i + {K - 1}], ' ')) as h from (select r, w, unnest(range(1, len(w) - {K - 2})) as i from docs where len(w) >= {K})),
hits as (select r, i from windows where h in (select h from windows group by h having count(*) > 1)),
gone as (select distinct r, i + j as p from hits, (select unnest(range({K})) as j)),
lists as (select r, list(p) as ps from gone group by r),
kept as (select d.doc_id, d.w, coalesce(len(l.ps), 0) as n, case when l.ps is null then d.w else list_transform(list_filter(range(1, len(d.w) + 1), lambda k: not list_contains(l.ps, k)), lambda k: d.w[k]) end as k
  from docs d left join lists l on d.r = l.r)
select doc_id, len(w) as n_words, n as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
