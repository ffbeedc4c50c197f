"""Group-relative rewards: advantages, statistics, selection. One shuffle on the group key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import last_by

EPS, EPS_GDPO = 1e-4, 1e-8


def known(x: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(x), x)


def weighted_reward(rewards: list[str], weights: list[float]) -> Column:
    """Weighted sum of rewards; missing ones add nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(known(F.col(r).cast("double")), F.lit(0.0)) * w for r, w in zip(rewards, weights, strict=True)])


def _spread(x: Column, w) -> Column:
    """Sample deviation; zero for a single value."""
    return F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))


def advantages(df: DataFrame, group: str, reward: str, kind: str = "grpo", scale: str = "group", eps: float = EPS, batch: str | None = None) -> DataFrame:
    """Adds advantage. kind: grpo, rloo, reinforce_pp; scale: group, batch or none.

    grpo: reward less the group's mean. rloo: (reward - mean) * K / (K - 1), plain for K = 1.
    Divided by the sample deviation of rewards in the group or batch; reinforce_pp takes the
    deviation of the advantages instead. batch names the column of a batch (all rows if None).
    """
    g = Window.partitionBy(group)
    mean, k = F.avg(reward).over(g), F.count(reward).over(g)
    plain = F.col(reward) - mean
    raw = F.when(k > 1, plain * k / (k - 1)).otherwise(plain) if kind == "rloo" else plain
    out = df.withColumn("advantage", raw)
    if scale == "none":
        return out
    base = F.col("advantage") if kind == "reinforce_pp" else F.col(reward)
    if scale == "group":
        return out.withColumn("__s", _spread(base, g)).withColumn("advantage", F.col("advantage") / (F.col("__s") + eps)).drop("__s")
    if batch:
        return out.withColumn("__s", _spread(base, Window.partitionBy(batch))).withColumn("advantage", F.col("advantage") / (F.col("__s") + eps)).drop("__s")
    whole = out.agg(F.coalesce(F.stddev_samp(base), F.lit(0.0)).alias("__s"))  # one row
    return out.join(F.broadcast(whole)).withColumn("advantage", F.col("advantage") / (F.col("__s") + eps)).drop("__s")


def gdpo(df: DataFrame, group: str, rewards: list[str], weights: list[float], eps: float = EPS_GDPO) -> DataFrame:
    """Each reward is standardised in its group, the weighted sum is standardised over all rows."""
    g = Window.partitionBy(group)
    out = df
    parts = []
    for i, (r, w) in enumerate(zip(rewards, weights, strict=True)):
        out = out.withColumn(f"__z{i}", (F.col(r) - F.avg(r).over(g)) / (_spread(F.col(r), g) + eps))
        parts.append(F.coalesce(F.col(f"__z{i}"), F.lit(0.0)) * w)
    out = out.withColumn("__a", reduce(lambda a, b: a + b, parts))
    whole = out.agg(F.avg("__a").alias("__m"), F.coalesce(F.stddev_samp("__a"), F.lit(0.0)).alias("__s"))  # one row
    return out.join(F.broadcast(whole)).withColumn("advantage", (F.col("__a") - F.col("__m")) / (F.col("__s") + eps)).select(*df.columns, "advantage")


def by_request(df: DataFrame, request: str, group: str, reward: str, order: str, **how) -> DataFrame:
    """Advantages over the last row of each request, handed to all rows of the request.

    Adds consistent: whether the rows of the request agree on the reward within 1e-6.
    """
    last = last_by(df.select(request, group, reward, order), request, order)
    per = advantages(last, group, reward, **how).select(request, "advantage")
    agree = df.groupBy(request).agg((F.max(reward) - F.min(reward) <= 1e-6).alias("consistent"))
    return df.join(per, request).join(agree, request)


def reward_stats(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Mean of group means, mean of group deviations, share of groups without spread."""
    per = df.groupBy(group).agg(F.avg(reward).alias("m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return per.agg(F.avg("m").alias("reward"), F.avg("s").alias("reward_std"), F.avg((F.col("s") < 1e-12).cast("double")).alias("frac_zero_std"))


def varied_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rows of groups whose rewards differ."""
    g = Window.partitionBy(group)
    return df.withColumn("__s", _spread(F.col(reward), g)).where("__s > 0").drop("__s")


def dynamic_batch(df: DataFrame, group: str, reward: str, order: str, groups: int) -> DataFrame:
    """The first groups with spread, in order; the original rows if there are not enough."""
    per = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"), F.min(order).alias("o")).where("s > 0")
    chosen = per.orderBy("o", group).limit(groups).select(group)
    return df if chosen.count() < groups else df.join(chosen, group, "left_semi")


def normalised(df: DataFrame, group: str, score: str, name: str = "score_norm") -> DataFrame:
    """Min-max within the group; where all are equal, 0 stays 0 and others are cut at 1."""
    g = Window.partitionBy(group)
    lo, hi = F.min(score).over(g), F.max(score).over(g)
    return df.withColumn(name, F.when(lo == hi, F.when(F.col(score) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col(score)))).otherwise((F.col(score) - lo) / (hi - lo + 1e-5)))


def rejection_select(df: DataFrame, group: str, tie: str, orm: str, prm: str, best: int = 1, threshold: float = 0.0, easy: float | None = None) -> DataFrame:
    """Chosen positives and the rejected worst candidate of each group.

    Score is prm + 10 * orm after normalising in the group. Positives pass both masks (above the threshold),
    are among the best and are not the worst; groups without any positive go, and so do easy
    groups, where more than the given share of candidates passes.
    """
    out = normalised(normalised(df, group, orm, "__o"), group, prm, "__p")
    out = out.withColumn("score", F.col("__p") + 10 * F.col("__o")).withColumn("__ok", (F.col("__o") > threshold) & (F.col("__p") > threshold))
    g = Window.partitionBy(group)
    top, low = g.orderBy(F.desc("score"), tie), g.orderBy("score", F.desc(tie))
    out = out.withColumn("__rank", F.row_number().over(top)).withColumn("rejected", F.row_number().over(low) == 1)
    out = out.withColumn("positive", F.col("__ok") & (F.col("__rank") <= best) & ~F.col("rejected"))
    out = out.withColumn("__any", F.max("positive").over(g)).withColumn("__share", F.avg(F.col("__ok").cast("double")).over(g))
    keep = F.col("__any") if easy is None else F.col("__any") & (F.col("__share") <= easy)
    return out.where(keep).where("positive or rejected").drop("__o", "__p", "__ok", "__rank", "__any", "__share")


def with_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Ground truth as an extra candidate."""
    return df.unionByName(truth, allowMissingColumns=True)


def throughput(df: DataFrame, request: str, order: str, prompt: str, generated: str, seconds: float) -> DataFrame:
    """Totals over the last row of each request, and rates."""
    last = last_by(df.select(request, order, prompt, generated), request, order)
    out = last.agg(F.count("*").alias("samples"), F.sum(prompt).alias("prompt_tokens"), F.sum(generated).alias("generated_tokens"))
    return out.withColumn("samples_per_s", F.col("samples") / seconds).withColumn("tokens_per_s", F.col("generated_tokens") / seconds)
