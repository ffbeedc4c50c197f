"""Evaluation metrics and losses as expressions and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bind import let
from .policy import log_softmax, total
from .tokens import MASKED

#: Ranges of values that average_rank orders apart.
RANK_RANGES = 1000
#: Pairs of a block of a batch, and anchors that meet a block at a time.
BATCH_BLOCK, TILE = 4096, 512
#: Pairs of a batch that in_batches() takes.
IN_BATCH = 1024
#: Words that one number of common_length() stands for.
BITS = 4096


def mean_or(x: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.avg(x), F.lit(empty))


def token_hits(predicted: Column, labels: Column) -> Column:
    """Per unmasked label: whether the prediction one place earlier is right."""
    pairs = F.arrays_zip(F.slice(predicted, 1, F.greatest(F.size(predicted) - 1, F.lit(0))).alias("p"), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))).alias("l"))
    return F.transform(F.filter(pairs, lambda x: x["l"] != MASKED), lambda x: x["p"] == x["l"])


def token_accuracy(df: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Accuracy over tokens, and over sequences in which all tokens are right."""
    hits = token_hits(F.col(predicted), F.col(labels))
    rows = df.select(F.size(hits).alias("n"), F.size(F.filter(hits, lambda h: h)).alias("h")).where("n > 0")
    return rows.agg((F.sum("h") / F.sum("n")).alias("token_acc"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("seq_acc"))


def exact_match(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    return df.agg(F.avg(predicted.eqNullSafe(label).cast("double")).alias("acc"))


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def multilabel_right(logits: Column, labels: Column) -> Column:
    """Whether the signs of all logits match the labels."""
    return F.forall(F.zip_with(logits, labels, lambda z, y: (z > 0) == (y == 1)), lambda b: b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))  # null for a zero vector


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def similarities(a: Column, b: Column) -> dict[str, Column]:
    return {"cosine": cosine(a, b), "manhattan": -manhattan(a, b), "euclidean": -euclidean(a, b), "dot": dot(a, b)}


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties at their mean; rows whose value is null or NaN go.

    Distinct values are counted first and dealt to at most RANK_RANGES ranges by their quantiles, so a
    window orders the values of one range only.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(value).agg(F.count("*").alias("__n"))
    marks = [i / RANK_RANGES for i in range(1, RANK_RANGES)]
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), marks, 4 * RANK_RANGES)).first()[0] or [0.0]
    ends = [float("-inf"), *sorted({x for x in cuts if abs(x) < float("inf")} or {0.0}), float("inf")]
    dealt = Bucketizer(splits=ends, inputCol="__v", outputCol="__r").transform(counts.withColumn("__v", F.col(value).cast("double")))
    sums = dealt.groupBy("__r").agg(F.sum("__n").alias("__m"))  # one row for each range
    sums = sums.select("__r", (F.sum("__m").over(Window.orderBy("__r")) - F.col("__m")).alias("__b"))
    before = F.sum("__n").over(Window.partitionBy("__r").orderBy(value)) - F.col("__n") + F.col("__b")
    ranks = dealt.join(sums, "__r").select(F.col(value).alias("__v"), (before + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, df[value] == ranks["__v"]).drop("__v")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman."""
    ranked = average_rank(average_rank(df.select(x, y), x, "__rx"), y, "__ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def label_groups(df: DataFrame, order: str, label: str, by: str | None = None) -> DataFrame:
    """Adds grp: a new group starts at each label 1 (in order); rows before the first go.

    by names a column that already separates queries, so that no window covers all rows.
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("grp", F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(w)).where("grp > 0")


def ranking_metrics(df: DataFrame, group: list[str], order: str, score: str, label: str) -> DataFrame:
    """MRR and NDCG of groups of two rows or more whose first row is the relevant one."""
    g = Window.partitionBy(*group)
    ranked = df.withColumn("__r", F.row_number().over(g.orderBy(F.desc(score), order))).withColumn("__first", F.row_number().over(g.orderBy(order)))
    ideal = ranked.withColumn("__i", F.row_number().over(g.orderBy(F.desc(label), order)))
    gain = lambda at: (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log2(F.col(at) + 1.0)
    per = ideal.groupBy(*group).agg(F.count("*").alias("n"), F.max(F.when(F.col("__first") == 1, 1.0 / F.col("__r"))).alias("rr"), F.sum(gain("__r")).alias("dcg"), F.sum(gain("__i")).alias("idcg"))
    per = per.where("n >= 2")
    return per.agg(mean_or(F.col("rr")).alias("mrr"), mean_or(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"))


def _blocks(pairs: DataFrame, batch: str, anchor: str, document: str, key: str) -> DataFrame:
    """Every block of a batch's pairs (side 1) beside every block of it (side 0), sorted by b, x, y and side.

    A batch of n pairs gives 2 * n * blocks rows, each with one pair; blocks have BATCH_BLOCK pairs on average.
    """
    vector = lambda c: F.col(c).cast("array<double>")
    rows = pairs.select(F.col(batch).alias("b"), F.col(key).alias("k"), vector(anchor).alias("q"), vector(document).alias("d"))
    counts = rows.groupBy("b").agg(F.ceil(F.count("*") / BATCH_BLOCK).cast("int").alias("blocks"))
    rows = rows.join(counts, "b").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    there = rows.select("b", every.alias("x"), F.col("own").alias("y"), F.lit(0).alias("side"), "k", "q", "d")
    here = rows.select("b", F.col("own").alias("x"), every.alias("y"), F.lit(1).alias("side"), "k", "q", "d")
    by = ["b", "x", "y"]
    return there.unionByName(here).repartition(*by).sortWithinPartitions(*by, "side")


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(pairs, the block that they meet): TILE pairs at most at a time."""
    at, block = None, []
    for pdf in batches:
        for name, g in pdf.groupby(["b", "x", "y", "side"], sort=False, dropna=False):
            if at != name[:3]:
                at, block = name[:3], []
            if name[3] == 0:
                block.append(g)
            else:
                block = [pd.concat(block)] if len(block) > 1 else block
                for i in range(0, len(g), TILE):
                    yield g.iloc[i : i + TILE], block[0]


def _summed(s: np.ndarray, counts: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each row among those that count (-inf: none), and the sum of exp((value - it) / temperature)."""
    top = np.where(counts, s, -np.inf).max(1, initial=-np.inf)
    base = np.where(np.isfinite(top), top, 0.0)
    return top, np.where(counts, np.exp((s - base[:, None]) / temperature), 0.0).sum(1)


def _total(parts: DataFrame, by: list[str], temperature: float, *more: Column) -> DataFrame:
    """Logarithm lse of the whole sum of exp(value / temperature), from tops and sums of blocks; no list is gathered."""
    most = parts.groupBy(*by).agg(F.max("top").alias("__most"))
    both = parts.join(most, by).withColumn("__z", F.when(F.col("top") > float("-inf"), F.col("z") * F.exp((F.col("top") - F.col("__most")) / temperature)).otherwise(0.0))
    return both.groupBy(*by).agg((F.ln(F.sum("__z")) + F.max("__most") / temperature).alias("lse"), *more)


def infonce_stats(pairs: DataFrame, batch: str, anchor: str, document: str, key: str, temperature: float = 0.1) -> DataFrame:
    """Per batch: mean positive and negative similarity, margin to the hardest negative, and the InfoNCE loss.

    Every anchor meets the documents of its own batch, in blocks: a product of matrices gives what each
    anchor has in a block (largest, sums, hardest), so there is neither a row for each two nor a row that holds a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, d in _met(batches):
            s = np.stack(a["q"]) @ np.stack(d["d"]).T
            own = a["k"].to_numpy()[:, None] == d["k"].to_numpy()
            top, z = _summed(s, np.ones_like(own), temperature)
            pos, hard = (np.where(m, s, -np.inf).max(1) for m in (own, ~own))
            yield pd.DataFrame({"b": a["b"], "k": a["k"], "top": top, "z": z, "pos": pos, "hard": hard, "neg": np.where(own, 0.0, s).sum(1), "n": (~own).sum(1)})

    rows = _blocks(pairs, batch, anchor, document, key)
    kinds = f"b {rows.schema['b'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}"
    parts = rows.mapInPandas(run, f"{kinds}, top double, z double, pos double, hard double, neg double, n long")
    finite = lambda c: F.when(F.col(c) > float("-inf"), F.col(c))
    per = _total(parts, ["b", "k"], temperature, F.max(finite("pos")).alias("pos"), F.max(finite("hard")).alias("hard"), (F.sum("neg") / F.nullif(F.sum("n"), F.lit(0))).alias("neg"))
    return per.groupBy(F.col("b").alias(batch)).agg(F.avg("pos").alias("mean_pos"), F.avg("neg").alias("mean_neg"), F.avg(F.col("pos") - F.col("hard")).alias("margin"), F.avg(F.col("lse") - F.col("pos") / temperature).alias("loss"))


def infonce_terms(pairs: DataFrame, batch: str, anchor: str, document: str, key: str, temperature: float = 0.1, fake_margin: float | None = None, queries: bool = True, documents: bool = True) -> DataFrame:
    """(key, loss) of every pair in its batch: infonce_loss() over similarities that are never held, block by block.

    Its own similarity is the positive. Negatives are other documents, other queries, and other documents as the
    positive sees them; the margin leaves out those of the first two kinds above positive + margin.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, d in _met(batches):
            q, p, to = np.stack(a["q"]), np.stack(a["d"]), np.stack(d["d"])
            own = a["k"].to_numpy()[:, None] == d["k"].to_numpy()
            pos = (q * p).sum(1)
            most = np.inf if fake_margin is None else pos[:, None] + fake_margin
            qd = q @ to.T
            kinds = [np.where(own | (qd > most), -np.inf, qd)]
            if queries:
                qq = q @ np.stack(d["q"]).T
                kinds.append(np.where(own | (qq > most), -np.inf, qq))
            if documents:
                kinds.append(np.where(own, -np.inf, p @ to.T))
            kinds.append(np.where(own.any(1), pos, -np.inf)[:, None])  # itself, once: where its block is
            s = np.concatenate(kinds, 1)
            top, z = _summed(s, np.isfinite(s), temperature)
            yield pd.DataFrame({"b": a["b"], "k": a["k"], "top": top, "z": z, "pos": pos})

    rows = _blocks(pairs, batch, anchor, document, key)
    kinds = f"b {rows.schema['b'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}"
    per = _total(rows.mapInPandas(run, f"{kinds}, top double, z double, pos double"), ["b", "k"], temperature, F.max("pos").alias("pos"))
    return per.select(F.col("k").alias(key), (F.col("lse") - F.col("pos") / temperature).alias("loss"))


def infonce_loss(sims: Column, positive: Column, temperature: float = 0.1, fake_margin: float | None = None, queries: Column | None = None, query: Column | None = None, documents: Column | None = None) -> Column:
    """Cross entropy of the positive among similarities; negatives above positive + margin can be left out.

    queries: similarities of the row's query to all queries, where place query is its own and counts nothing.
    documents: similarities of its positive to all documents; the margin leaves none of these out.
    """

    def others(values: Column, own: Column, most: Column | None) -> Column:
        fine = lambda s, i: (i != own) if most is None else (i != own) & (s <= most)
        return F.filter(F.transform(values, lambda s, i: F.when(fine(s, i), s)), lambda s: s.isNotNull())

    def of(own: Column) -> Column:
        most = None if fake_margin is None else own + fake_margin
        parts = [F.array(own), others(sims, positive, most)]
        if queries is not None:
            parts.append(others(queries, query, most))
        if documents is not None:
            parts.append(others(documents, positive, None))
        loss = lambda k, top: F.ln(total(F.transform(k, lambda s: F.exp((s - top) / temperature)))) + (top - own) / temperature
        return let(lambda k: let(lambda top: loss(k, top), F.array_max(k)), F.concat(*parts))

    return let(of, F.get(sims, positive))


def in_batches(pairs: DataFrame, batch: str, anchor: str, document: str, key: str) -> DataFrame:
    """Adds place (in its batch, by key) and the similarities qd, qq and dd of each pair to its whole batch.

    For batches of IN_BATCH pairs or fewer, where a larger one is an error; infonce_terms() takes any.
    """
    few = F.assert_true(F.count("*") <= IN_BATCH, F.lit(f"a batch has more than {IN_BATCH} pairs"))
    lists = pairs.groupBy(batch).agg(few.alias("__few"), F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(anchor).alias("q"), F.col(document).alias("d")))).alias("__l")).where("__few is null")
    rows = pairs.join(lists, batch)
    scores = lambda a, of: F.transform("__l", lambda x: dot(a, x[of]))
    q, d = F.col(anchor), F.col(document)
    place = (F.array_position(F.col("__l.k"), F.col(key)) - 1).cast("int")
    return rows.select(*pairs.columns, place.alias("place"), scores(q, "d").alias("qd"), scores(q, "q").alias("qq"), scores(d, "d").alias("dd"))


def pair_losses(df: DataFrame, a: str, b: str, label: str, margin: float = 0.5) -> DataFrame:
    """Cosine mean squared error, contrastive loss and online contrastive loss of a batch."""
    rows = df.select(cosine(F.col(a), F.col(b)).alias("c"), F.col(label).cast("double").alias("y")).withColumn("d", 1 - F.col("c"))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    ends = rows.agg(F.max(F.when(pos, F.col("d"))).alias("pmax"), F.count(F.when(pos, 1)).alias("np"), F.avg(F.when(neg, F.col("d"))).alias("nmean"), F.min(F.when(neg, F.col("d"))).alias("nmin"), F.count(F.when(neg, 1)).alias("nn"), F.avg(F.when(pos, F.col("d"))).alias("pmean"))
    full = rows.join(F.broadcast(ends))  # one row
    hard_neg = neg & (F.col("d") < F.when(F.col("np") > 1, F.col("pmax")).otherwise(F.col("nmean")))
    hard_pos = pos & (F.col("d") > F.when(F.col("nn") > 1, F.col("nmin")).otherwise(F.col("pmean")))
    gap = F.greatest(F.lit(margin) - F.col("d"), F.lit(0.0))
    return full.agg(
        F.avg((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))).alias("cosine_mse"), F.avg(0.5 * (F.col("y") * F.col("d") * F.col("d") + (1 - F.col("y")) * gap * gap)).alias("contrastive"),
        (F.coalesce(F.sum(F.when(hard_pos, F.col("d") * F.col("d"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(hard_neg, gap * gap)), F.lit(0.0))).alias("online_contrastive"),
    )


def pointwise_bce(score: Column, label: Column) -> Column:
    """Binary cross entropy with logits."""
    return F.greatest(score, F.lit(0.0)) - score * label + F.log1p(F.exp(-F.abs(score)))


def listwise_ce(df: DataFrame, group: list[str], order: str, score: str, temperature: float = 1.0, least: int = 2) -> DataFrame:
    """Mean cross entropy of the first row of each group among the group."""
    per = df.groupBy(*group).agg(F.count("*").alias("n"), F.min(F.struct(order, score)).alias("f"), F.max(score).alias("m"), F.array_sort(F.collect_list(score)).alias("all")).where(F.col("n") >= least)
    z = F.ln(total(F.transform("all", lambda s: F.exp((s - F.col("m")) / temperature)))) + F.col("m") / temperature
    return per.agg(mean_or(z - F.col(f"f.{score}") / temperature).alias("loss"))


def token_nll(logits: Column, label: Column, dft: bool = False) -> Column:
    """Cross entropy of a label under logits (0 if masked); with dft weighted by its own probability."""
    loss = -F.element_at(log_softmax(logits), label + 1)
    return F.when(label == MASKED, 0.0).otherwise(loss * F.exp(-loss) if dft else loss)


def weighted_loss(df: DataFrame, losses: str, scales: str) -> DataFrame:
    """Sum of token losses times scales over the number of counted tokens."""
    s = total(F.zip_with(losses, scales, lambda x, w: x * w))
    n = F.size(F.filter(F.col(scales), lambda w: w > 0))
    return df.agg((F.sum(s) / F.sum(n)).alias("loss"))


def ngram_counts(words: Column, n: int) -> Column:
    return let(lambda w: _ngrams(w, n), words)


def _ngrams(words: Column, n: int) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: i <= F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def rouge_n(got: Column, want: Column, n: int) -> Column:
    """F1 over distinct n-grams of word arrays."""
    a, b = F.array_distinct(ngram_counts(got, n)), F.array_distinct(ngram_counts(want, n))
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence; the rows of its table are bits of one number for each BITS words of a.

    What leaves a number at its top comes in at the foot of the next, so that memory grows with the words, not with their square.
    """
    carried, out = bytearray(len(b)), 0
    for start in range(0, len(a), BITS):
        part = a[start : start + BITS]
        at: dict = {}
        for i, x in enumerate(part):
            at[x] = at.get(x, 0) | 1 << i
        row = whole = (1 << len(part)) - 1
        for j, x in enumerate(b):
            hit = row & at.get(x, 0)
            more = row + hit + carried[j]
            carried[j] = more >> len(part)
            row = (more | row - hit) & whole
        out += len(part) - row.bit_count()
    return out


@F.arrow_udf(T.LongType())
def common_lengths(got: pa.Array, want: pa.Array) -> pa.Array:
    """common_length() of each two arrays; only one row at a time is made of Python's objects."""
    return pa.array([common_length(a.as_py(), b.as_py()) if a.is_valid and b.is_valid else None for a, b in zip(got, want, strict=True)], pa.int64())


def rouge_l(got: Column, want: Column) -> Column:
    """F1 of the longest common subsequence of word arrays."""
    return F.when((F.size(got) > 0) & (F.size(want) > 0), 2.0 * common_lengths(got, want) / (F.size(got) + F.size(want))).otherwise(0.0)


def bleu(got: Column, want: Column, n: int = 4) -> Column:
    """BLEU with counts plus one above unigrams and brevity penalty."""

    def precision(k: int) -> Column:
        count = lambda xs, g: F.size(F.filter(xs, lambda x: x == g))
        hits = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.least(count(a, g), count(b, g)))
        smooth = 0 if k == 1 else 1
        return let(lambda a, b: (hits(a, b) + smooth) / F.greatest(F.size(a) + smooth, F.lit(1)), ngram_counts(got, k), ngram_counts(want, k))

    logs = [F.ln(F.greatest(precision(k), F.lit(1e-12))) / n for k in range(1, n + 1)]
    short = F.least(F.lit(0.0), 1 - F.size(want) / F.greatest(F.size(got), F.lit(1)))
    return F.when(F.size(got) == 0, 0.0).otherwise(F.exp(sum(logs[1:], logs[0]) + short))


def trimmed_negatives(negatives: Column, n: int, key: Column, seed: str = "negatives") -> Column:
    """Exactly n negatives: the first n, or all and then some again, drawn by hash; none stay none."""
    draw = lambda xs, i: F.get(xs, F.pmod(F.xxhash64(key, i, F.lit(seed)), F.greatest(F.size(xs), F.lit(1))).cast("int"))
    some = lambda xs: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(xs, i), draw(xs, i)))
    return let(lambda xs: F.when(F.size(xs) == 0, xs).otherwise(some(xs)), negatives)
