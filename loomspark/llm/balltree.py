"""Hard negatives by ball trees: branch and bound on inner products, inside blocks of rows.

The rows are dealt by hash to blocks, however labels or vectors clump. A task grows ball trees
over its block, one for each label and one for all, and streams the anchors through
them. The inner product of an anchor a with any vector of a ball (centre c, radius r) lies within
a.c - |a|r and a.c + |a|r. A node is passed by where that range misses the window of scores that are
asked for, lies beneath the anchor's current k-th score, or only ties with it at larger ids.
Blocks pass on their k best, so what is merged for an anchor is k rows a block.

Two passes: the first finds an anchor's positives; their scores make the windows of the second.
All scores are of whole numbers, in doubles where those are exact and in longs elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Bytes of a block's components as doubles; rows of a block below which blocks are not made smaller; rows of a leaf.
BLOCK_BYTES, FEW, LEAF = 64 << 20, 1024, 64
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: Of a hundred parts of a positive's score, what a negative has at least.
WINDOW = 80
NONE = np.iinfo(np.int64).min


@dataclass
class Ball:
    """Rows (positions in the block) inside a ball; inner nodes have two halves."""

    centre: np.ndarray
    radius: float
    size: float
    rows: np.ndarray
    first: int
    halves: tuple[Ball, Ball] | None = None


def grow(x: np.ndarray, rows: np.ndarray) -> Ball:
    """A ball tree over rows of x, halved along the line between two points far apart."""
    own = x[rows]
    centre = own.mean(0)
    away = ((own - centre) ** 2).sum(1)
    ball = Ball(centre, math.sqrt(away.max()), float(np.sqrt((centre**2).sum())), rows, int(rows.min()))
    if len(rows) > LEAF:
        far = own[away.argmax()]
        other = own[((own - far) ** 2).sum(1).argmax()]
        by = np.argsort((own - far) @ (other - far), kind="stable")
        half = len(rows) // 2
        ball.halves = grow(x, rows[by[:half]]), grow(x, rows[by[half:]])
    return ball


class Asked:
    """Anchors with their windows, and the best k rows of a block found so far (positions; -1: none)."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.vectors, self.rows, self.labels, self.low, self.high, self.k = vectors, rows, labels, low, high, k
        self.norms = np.sqrt((vectors**2).sum(1))
        self.score = np.full((len(rows), k), NONE)
        self.place = np.full((len(rows), k), -1)

    def may(self, ball: Ball, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of who for whom the ball can hold a better row, and its upper bounds for them."""
        mid, reach = self.vectors[who] @ ball.centre, self.norms[who] * ball.radius
        slack = 1e-6 + 1e-9 * self.norms[who] * (ball.size + ball.radius)
        up, lo = np.floor(mid + reach + slack), np.ceil(mid - reach - slack)
        kth, at = self.score[who, -1], self.place[who, -1]
        better = (up > kth) | ((up == kth) & (ball.first < at)) | (at < 0)
        fits = better & (up >= self.low[who]) & (lo <= self.high[who])
        return who[fits], up[fits]

    def visit(self, ball: Ball, who: np.ndarray, block: Block, other_label: bool) -> None:
        if ball.halves is None:
            return self.read(ball.rows, who, block, other_label)
        for half, _ in sorted(((h, -self.may(h, who)[1].sum()) for h in ball.halves), key=lambda x: x[1]):
            left = self.may(half, who)[0]  # again: the first half may have raised what counts
            if len(left):
                self.visit(half, left, block, other_label)

    def read(self, rows: np.ndarray, who: np.ndarray, block: Block, other_label: bool) -> None:
        score = block.scores(self.vectors[who], rows)
        out = (block.rows[rows] == self.rows[who, None]) | (score < self.low[who, None]) | (score > self.high[who, None])
        if other_label:
            out |= block.labels[rows] == self.labels[who, None]
        score[out] = NONE
        kth, at = self.score[who, -1, None], self.place[who, -1, None]
        new = (~out & ((score > kth) | ((score == kth) & (rows < at)))).any(1)
        if not new.any():
            return
        who, score = who[new], score[new]
        both = np.concatenate([self.score[who], score], 1)
        place = np.concatenate([self.place[who], np.where(score == NONE, -1, rows)], 1)
        best = np.lexsort((place, -np.maximum(both, NONE + 1)), axis=-1)[:, : self.k]
        self.score[who], self.place[who] = np.take_along_axis(both, best, 1), np.take_along_axis(place, best, 1)


class Block:
    """Rows of one block that have equally many components, in order of id (nulls last), and their trees."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["vec_id", "row"], na_position="last")
        self.x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        self.rows, self.labels, self.ids = pdf["row"].to_numpy(), pdf["label"].to_numpy(), pdf["vec_id"].array
        self.largest = math.sqrt((self.x**2).sum(1).max()) if self.x.size else 0.0
        self.by_label: dict[int, Ball] = {}
        self.all: Ball | None = None

    def scores(self, vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.largest * math.sqrt((vectors**2).sum(1).max(initial=0)) < 2**52:
            return np.rint(vectors @ self.x[rows].T).astype(np.int64)
        return vectors.astype(np.int64) @ self.x[rows].T.astype(np.int64)

    def positives(self, asked: Asked) -> None:
        for label in np.unique(asked.labels).tolist():
            if label not in self.by_label:
                rows = np.flatnonzero(self.labels == label)
                self.by_label[label] = grow(self.x, rows) if len(rows) else None
            if self.by_label[label]:
                asked.visit(self.by_label[label], np.flatnonzero(asked.labels == label), self, False)

    def negatives(self, asked: Asked) -> None:
        self.all = self.all or grow(self.x, np.arange(len(self.x)))
        asked.visit(self.all, np.arange(len(asked.rows)), self, True)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, pd.DataFrame]]:
    """Each batch of anchors with the block it meets; rows come before anchors, by block and length."""
    at, rows, block = None, [], None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[["block", "dim", "asks"]].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(pdf)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if at != tuple(keys[s, :2]):
                at, rows, block = tuple(keys[s, :2]), [], None
            if not keys[s, 2]:
                rows.append(pdf.iloc[s:e])
            elif rows:
                block = block or Block(pd.concat(rows))
                yield block, pdf.iloc[s:e]


def clean(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, vec_id, label, dim and whole-number components v of every row that takes part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda s, c: s + (256 * c.cast("double")) * (256 * c.cast("double")))
    id_ = F.col("vec_id").cast("long")
    own = F.col(label).cast("long")
    named = F.when(id_ % 7 == 0, (own + 1) % 10).otherwise(own)
    out = vectors.where(F.col(label).isNotNull() & x.isNotNull()).where(finite).where(square < 2.0**61)
    return out.select(F.monotonically_increasing_id().alias("row"), id_.alias("vec_id"), named.alias("label"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(256 * c.cast("double")).cast("int")).alias("v"))


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, found: str, search) -> DataFrame:
    """Every anchor with every block of rows, by search over (block, anchors)."""
    schema = [c for c in anchors.columns if c not in rows.columns]
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    here = rows.select(block.alias("block"), F.lit(0).alias("asks"), *rows.columns, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in schema])
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), *rows.columns, *schema)
    by = ["block", "dim", "asks"]
    return here.unionByName(there).repartitionById(blocks, F.col("block")).sortWithinPartitions(*by).mapInPandas(lambda batches: (search(b, a) for b, a in _streamed(batches)), found)


def _first(found: DataFrame, by: list[str], score: str, id_: str, rank: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id_))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, anchors: Column | None = None, vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by 100, or those that the condition (of
    row, vec_id, label, dim, v) names. Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those
    whose squared length in whole numbers reaches 2**61, as scores would not fit a long. Only
    vectors of equal length have a score. A row without vec_id is no anchor by default, and comes
    last among equal scores, as null. Rows that repeat a vec_id are rows of their own: another
    row under an anchor's id can be its positive, and equal anchors each return their rows. No anchor,
    no positive or none in the window: no row. Empty tables give empty results; other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = materialise(clean(vectors, vector, label), 0)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("dim")), F.lit(0))).first()
    blocks = max(1, min(2 * spark.sparkContext.defaultParallelism, n // FEW), -(-size // BLOCK_BYTES))
    asked = rows.where(F.col("vec_id") % 100 == 0 if anchors is None else anchors)

    def positives(block: Block, pdf: pd.DataFrame) -> pd.DataFrame:
        n, a = len(pdf), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        q = Asked(a, pdf["row"].to_numpy(), pdf["label"].to_numpy(), np.full(n, NONE), np.full(n, -NONE - 1), POSITIVES)
        block.positives(q)
        who, _ = np.nonzero(q.place >= 0)
        return pd.DataFrame({"row": q.rows[who], "positive_score": q.score[q.place >= 0], "positive_id": block.ids[q.place[q.place >= 0]]})

    found = _met(rows, asked, blocks, "row long, positive_score long, positive_id long", positives)
    found = _first(found, ["row"], "positive_score", "positive_id", "positive", POSITIVES)
    pairs = found.groupBy("row").agg(F.collect_list(F.struct("positive", "positive_score", "positive_id")).alias("p"))
    part = lambda c: F.col(f"p.{c}").alias(c)
    pairs = materialise(asked.join(pairs, "row").select(*asked.columns, part("positive"), part("positive_score"), part("positive_id")))

    def negatives(block: Block, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["positive"].str.len().to_numpy()
        each = np.repeat(np.arange(len(pdf)), n)
        a = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        top = np.concatenate(pdf["positive_score"].to_list()).astype(np.int64)
        low = -(-WINDOW * top // 100)  # a negative score has no window
        use = np.flatnonzero(low <= top)
        each, top, low = each[use], top[use], low[use]
        q = Asked(a[each], pdf["row"].to_numpy()[each], pdf["label"].to_numpy()[each], low, top, NEGATIVES)
        block.negatives(q)
        who, _ = np.nonzero(q.place >= 0)
        ids = pd.array([x for v in pdf["positive_id"] for x in v], "Int64")[use]
        return pd.DataFrame({"row": q.rows[who], "positive": np.concatenate(pdf["positive"].to_list())[use][who], "anchor_id": pdf["vec_id"].array[each[who]], "positive_id": ids[who], "positive_score": top[who], "negative_score": q.score[q.place >= 0], "negative_id": block.ids[q.place[q.place >= 0]]})

    wide = "row long, positive int, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long"
    out = _first(_met(rows, pairs, blocks, wide, negatives), ["row", "positive"], "negative_score", "negative_id", "rank", NEGATIVES)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same in DuckDB, with every anchor against every row.
SQL = """
with base as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.r, a.vec_id, a.label, b.r as r2, b.vec_id as id, b.label as label2, list_inner_product(a.v, b.v)::bigint as score
  from base a join base b on a.vec_id % 100 = 0 and a.r <> b.r and len(a.v) = len(b.v)),
positives as (select * from scores where label2 = label qualify row_number() over (partition by r order by score desc, id nulls last) <= 5)
select p.vec_id as anchor_id, p.id as positive_id, row_number() over (partition by p.r, p.r2 order by s.score desc, s.id nulls last)::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from positives p join scores s on p.r = s.r and s.label2 <> s.label and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify row_number() over (partition by p.r, p.r2 order by s.score desc, s.id nulls last) <= 5
"""
