"""Toxicity: cumulative-link ordinal regression over sparse word features.

One weight vector is shared by all severity thresholds: P(grade > k) = sigmoid(w.x - t_k)
with t_0 < t_1 < ...; a document's severity is its expected grade, the sum of these.
The model is fitted in numpy on a bounded sample of labelled documents (LABELLED), spread
by hash, of which near copies count once. Features are all words and word beginnings that
speak for or against toxicity more than chance allows (BY_CHANCE of them are expected by chance), with
weights of either sign. The label table only says toxic or not; grades above 0 come from how densely a
toxic document uses words that set toxic documents apart in the other half of the sample, so no
document has a part in choosing the words that grade it. A document is rejected at the
severity that did best on held-out parts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: At most this many labelled documents are used for fitting.
LABELLED = 4000
#: Hash buckets of words.
BUCKETS = 1 << 20
#: Severity grades 0..GRADES-1.
GRADES = 4
#: Words that may become features by chance, on average.
BY_CHANCE = 5.0
WORDS = re.compile(r"[^\W\d_]+")
#: Parts of the sample that are held out in turn for the threshold.
FOLDS = 3
#: Distinct words whose weight a worker remembers.
CACHE_WORDS = 300_000


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def parts(word: str) -> tuple[int, ...]:
    """Buckets of a word's features: itself, and its first four and five letters (endings vary)."""
    return tuple({bucket(word), *(bucket(f"{word[:k]}*") for k in (4, 5) if len(word) > k)})


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def copy_keys(text: str | None) -> list[int]:
    """Four least hashes over five-word shingles; near copies share some of them."""
    words = (text or "").lower().split()
    shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
    h = np.fromiter(shingles, np.uint64)
    return [int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 2246822519, 3266489917, 668265263)]


@dataclass
class Ordinal:
    """Weights by hash bucket, ordered thresholds, and the severity from which a document is rejected."""

    weights: dict[int, float]
    cuts: list[float]
    reject: float
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        cache, weights, total = self.cache, self.weights, 0.0
        for word, n in word_counts(text).items():
            w = cache.get(word)
            if w is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                w = cache[word] = sum(weights.get(b, 0.0) for b in parts(word))
            if w:
                total += w * math.log1p(n)
        return total

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return (1 / (1 + np.exp(np.clip(np.array(self.cuts) - np.asarray(score)[:, None], -60, 60)))).sum(1)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k), one column for each grade."""
        above = 1 / (1 + np.exp(np.clip(np.array(self.cuts) - np.asarray(score)[:, None], -60, 60)))
        edges = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
        return edges[:, :-1] - edges[:, 1:]


def fit_cuts(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 0.003, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of least penalised negative log-likelihood (Adam on all rows)."""
    n, f = x.shape
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    # cuts as a first value and positive gaps, so that they stay ordered
    p = np.concatenate([np.zeros(f), [first[0]], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        gaps = np.exp(np.clip(p[f + 1 :], -10, 5))
        cuts = p[f] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = 1 / (1 + np.exp(np.clip(cuts - (x @ p[:f])[:, None], -40, 40)))  # P(y > k)
        edge = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        rows = np.arange(n)
        prob = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        up, down = slope[rows, y] / prob, slope[rows, y + 1] / prob
        gz = (down - up) / n
        gc = np.zeros((n, grades + 1))
        gc[rows, y] += up / n
        gc[rows, y + 1] -= down / n
        gcut = gc[:, 1:-1].sum(0)
        tail = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([x.T @ gz + l2 * p[:f], [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(p[f + 1 :], -10, 5))
    return p[:f], p[f] + np.concatenate([[0.0], np.cumsum(gaps)])


def evidence(n1: np.ndarray, n0: np.ndarray, t1: int, t0: int) -> np.ndarray:
    """Log-likelihood ratio of a word against independence; negative where it speaks for clean."""
    total = t1 + t0

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)

    n = n1 + n0
    g = 2 * (part(n1, n * t1 / total) + part(n0, n * t0 / total) + part(t1 - n1, (total - n) * t1 / total) + part(t0 - n0, (total - n) * t0 / total))
    return np.where(n1 * t0 > n0 * t1, g, -g)


def least_evidence(words: int) -> float:
    """The log-likelihood ratio that BY_CHANCE of so many unrelated words would reach (tail of chi-squared, one degree)."""
    g = 1.0
    for _ in range(50):
        g = max(1.0, 2 * math.log(max(words, 1) / BY_CHANCE * math.sqrt(2 / (math.pi * g))))
    return g


def markers(x_at: np.ndarray, owner: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Signed evidence of each feature in these documents, 0 below least_evidence()."""
    n1, n0 = np.bincount(x_at, y[owner], size), np.bincount(x_at, 1 - y[owner], size)
    docs = np.unique(owner)
    g = evidence(n1, n0, int(y[docs].sum()), int((1 - y[docs]).sum()))
    return np.where(np.abs(g) >= least_evidence(int((n1 + n0 > 0).sum())), g, 0)


def fit(rows: list[tuple[int, int, list[int], list[float], list[int]]], grades: int = GRADES) -> Ordinal:
    """rows: (toxic, words, feature buckets, their values, copy keys) of each labelled document, in a fixed order."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for row in rows:
        keys = set(enumerate(row[4]))
        if not keys & seen:
            kept.append(row)
        seen |= keys
    y = np.array([int(r[0] > 0) for r in kept], np.int64)
    t1, t0 = int(y.sum()), int(len(y) - y.sum())
    if not t1 or not t0:
        return Ordinal({}, [50.0 + k for k in range(grades - 1)], 0.5)
    owner = np.repeat(np.arange(len(kept), dtype=np.int32), [len(r[2]) for r in kept])
    words = np.concatenate([np.asarray(r[2], np.int32) for r in kept])
    tf = np.concatenate([np.asarray(r[3], np.float32) for r in kept])
    names, at = np.unique(words, return_inverse=True)
    g = markers(at, owner, y, len(names))
    strong = np.flatnonzero(g)
    place = np.full(len(names), -1)
    place[strong] = np.arange(len(strong))
    use = place[at] >= 0
    x = np.zeros((len(kept), len(strong)))
    x[owner[use], place[at][use]] = tf[use]
    # severity of toxic documents: by thirds of the density of the other half's marker words
    length = np.array([max(1, r[1]) for r in kept], float)
    density = np.zeros(len(kept))
    for half in (0, 1):
        there = owner % 2 != half
        if y[np.unique(owner[there])].any():
            mark = markers(at[there], owner[there], y, len(names)) > 0
            mine = (owner % 2 == half) & mark[at]
            density += np.bincount(owner[mine], tf[mine], len(kept)) / length
    grade = y.copy()
    marked = (y == 1) & (density > 0)
    if marked.any():
        for q in np.quantile(density[marked], [k / (grades - 1) for k in range(1, grades - 1)]):
            grade[marked & (density > q)] += 1
    # the threshold comes from severities that each third gets from a model of the other two
    fold, s, reject = np.arange(len(kept)) % FOLDS, np.zeros(len(kept)), float(grades)
    known = np.zeros(len(kept), bool)  # whether the words say more than nothing
    if all(y[fold != f].any() for f in range(FOLDS)):
        for f in range(FOLDS):
            w, cuts = fit_cuts(x[fold != f], grade[fold != f], grades)
            s[fold == f] = Ordinal({}, list(cuts), 0).severity(x[fold == f] @ w)
            known[fold == f] = x[fold == f] @ w > 0
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
        sorted_s = s[order]
        f1[:-1][sorted_s[:-1] == sorted_s[1:]] = 0  # a cut within equal severities is none
        f1[~known[order]] = 0  # nor is one that rejects texts without any evidence against them
        best = int(f1.argmax())
        if f1[best] > 0:
            below = sorted_s[best + 1] if best + 1 < len(s) else 0.0
            reject = float((sorted_s[best] + below) / 2)
    w, cuts = fit_cuts(x, grade, grades)
    return Ordinal({int(names[i]): float(v) for i, v in zip(strong, w, strict=True)}, [float(c) for c in cuts], reject)


def fit_from(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Ordinal:
    """Fit on at most limit labelled documents; only their features reach the driver.

    Of the rows that share a labelled doc_id, the one whose text has the least md5 counts, so that no
    more than limit rows leave the executors however often an id is repeated. Labels without doc_id or toxic, and labels of absent documents, count for nothing;
    without both classes the model rejects nothing.
    """
    bound_batches(docs.sparkSession)
    some = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # one row for each id, chosen before the shuffle where a task has several: at most limit rows
    joined = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "n": [], "features": [], "values": [], "keys": []}
            for t in pdf["text"]:
                words, c = word_counts(t), {}
                for w, n in words.items():
                    for b in parts(w):
                        c[b] = c.get(b, 0.0) + math.log1p(n)
                out["n"].append(sum(words.values()))
                out["features"].append(list(c.keys()))
                out["values"].append(list(c.values()))
                out["keys"].append(copy_keys(t))
            yield pd.DataFrame(out)

    got = joined.mapInPandas(counts, "doc_id long, toxic long, n long, features array<int>, values array<float>, keys array<long>").toArrow()
    columns = [got.column(c).to_numpy() for c in ("toxic", "n", "features", "values")]
    ids, keys = got.column("doc_id").to_pylist(), got.column("keys").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], keys[i]))
    return fit([(*(c[i] for c in columns), keys[i]) for i in order])


def score_documents(docs: DataFrame, model: Ordinal, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Severity of every whole text; a narrow transformation, no shuffle.

    Adds score, severity (expected grade), grade (the likeliest) and toxic (whether the
    severity reaches the model's threshold). A null or empty text scores 0 and is judged
    like a text without known words.
    """
    bound_batches(docs.sparkSession)
    kept = docs.select(*keep, docs[text].alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts, model.reject))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Ordinal(*sent.value)
        for pdf in batches:
            score = np.array([m.score(t) for t in pdf.pop("__text")], float)
            pdf["score"], pdf["severity"] = score, m.severity(score) if len(score) else score
            pdf["grade"] = m.probabilities(score).argmax(1).astype(np.int32) if len(score) else score.astype(np.int32)
            pdf["toxic"] = pdf["severity"].to_numpy() >= m.reject
            yield pdf

    fields += ", score double, severity double, grade int, toxic boolean"
    return kept.mapInPandas(run, fields)


def toxic_column(model: Ordinal, text: Column) -> Column:
    """Whether the model rejects a text, as a column: only the text goes to Python."""

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        score = np.array([model.score(t) for t in texts], float)
        return pd.Series(model.severity(score) >= model.reject if len(score) else score.astype(bool))

    return judge(text)
