"""Policy-gradient arithmetic over arrays of token log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bind import let

BOUND = 20.0
#: Parts of a range in one round of a quantile, and values that the driver may sort at the end.
BINS, LAST = 4096, 10_000


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def masked_mean(x: Column, mask: Column) -> Column:
    return total(F.zip_with(x, mask, lambda a, m: a * m)) / F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1.0))


def log_ratio(new: Column, old: Column) -> Column:
    return F.zip_with(new, old, lambda a, b: a - b)


def safe_exp(x: Column) -> Column:
    return F.exp(F.greatest(F.least(x, F.lit(BOUND)), F.lit(-BOUND)))


def sequence_ratio(ratio: Column, mask: Column) -> Column:
    """Geometric mean of token ratios."""
    return F.exp(masked_mean(F.transform(ratio, lambda r: F.ln(F.greatest(r, F.lit(1e-10)))), mask))


def rollout_weights(ratio_log: Column, mask: Column, mode: str, most: float = 2.0) -> Column:
    """Importance weights of tokens: token or sequence level, truncated or masked at most."""
    ratio = F.transform(ratio_log, safe_exp)
    if mode == "token_truncate":
        return F.transform(ratio, lambda r: F.least(r, F.lit(most)))
    if mode == "token_mask":
        return F.transform(ratio, lambda r: F.when(r <= most, r).otherwise(0.0))
    whole = lambda use: let(lambda rs, w: F.transform(rs, lambda r: use(r, w)), ratio, sequence_ratio(ratio, mask))
    if mode == "sequence_truncate":
        return whole(lambda r, w: F.least(w, F.lit(most)))
    if mode == "sequence_mask":
        return whole(lambda r, w: F.when(w <= most, r).otherwise(0.0))
    return ratio


def off_policy_kept(new: Column, old: Column, mask: Column, advantage: Column, delta: float) -> Column:
    """False where the mean log ratio old - new exceeds delta and the advantage is negative."""
    return ~((masked_mean(log_ratio(old, new), mask) > delta) & (advantage < 0))


def token_losses(new: Column, old: Column, mask: Column, advantage: Column, kind: str = "grpo", low: float = 0.2, high: float = 0.2, level: str = "token", delta: float | None = None, tau: tuple[float, float] = (1.0, 1.05)) -> Column:
    """Loss of every token: clipped ratio (grpo, bnpo, dr_grpo, dapo), cispo or sapo."""
    ratio = log_ratio(new, old)
    if level != "token":
        ratio = let(lambda rs, w: F.transform(rs, lambda _: w), ratio, masked_mean(ratio, mask))
    ratio = F.transform(ratio, F.exp)
    if kind == "cispo":
        return F.zip_with(ratio, new, lambda r, n: -F.least(r, F.lit(high)) * advantage * n)
    if kind == "sapo":

        def gate(r: Column, t: float) -> Column:
            return 1 / (1 + F.exp(-t * (r - 1))) * (4.0 / t)

        return F.transform(ratio, lambda r: -F.when(advantage > 0, gate(r, tau[0])).otherwise(gate(r, tau[1])) * advantage)

    def clipped(r: Column) -> Column:
        inside = F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low))
        outer = r if delta is None else F.least(r, F.lit(delta))
        return -F.least(outer * advantage, inside * advantage)

    return F.transform(ratio, clipped)


def clip_fraction(new: Column, old: Column, mask: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """Share of tokens whose ratio is clipped on the side that matters."""
    ratio = F.transform(log_ratio(new, old), F.exp)
    return masked_mean(F.transform(ratio, lambda r: F.when(((r < 1 - low) & (advantage < 0)) | ((r > 1 + high) & (advantage > 0)), 1.0).otherwise(0.0)), mask)


def kl_tokens(new: Column, ref: Column) -> Column:
    """exp(d) - d - 1 with d = ref - new."""
    return F.zip_with(new, ref, lambda n, r: F.exp(r - n) - (r - n) - 1)


def batch_loss(df: DataFrame, losses: str, mask: str, kind: str = "grpo", longest: int = 1, items: float | None = None) -> DataFrame:
    """The loss of a batch from token losses: per sequence mean, per token mean, or fixed normalisers."""
    s = total(F.zip_with(losses, mask, lambda x, m: x * m))
    n = total(F.transform(mask, lambda m: m.cast("double")))
    if kind in ("grpo", "sapo"):
        value = F.avg(s / F.greatest(n, F.lit(1.0)))
    elif kind == "bnpo":
        value = F.sum(s) / F.greatest(F.sum(n), F.lit(1.0))
    elif kind == "dr_grpo":
        value = F.sum(s) / (F.count("*") * longest)
    else:
        value = F.sum(s) / (F.sum(n) if items is None else F.lit(float(items)))
    return df.agg(value.alias("loss"))


def off_policy_metrics(df: DataFrame, new: str, old: str, mask: str) -> DataFrame:
    """Perplexities, KL estimates, ratio of perplexities and chi-squared of a batch, in one pass."""
    n, o, m = F.col(new), F.col(old), F.col(mask)
    d = F.zip_with(log_ratio(n, o), m, lambda x, k: x * k)
    sums = df.select(
        masked_mean(n, m).alias("n"), masked_mean(o, m).alias("o"), masked_mean(d, m).alias("d"), total(F.zip_with(d, m, lambda x, k: x * k)).alias("ds"),
        total(F.zip_with(d, m, lambda x, k: (F.exp(x) - x - 1) * k)).alias("k3"), total(F.zip_with(d, m, lambda x, k: safe_exp(x) * safe_exp(x) * k)).alias("r2"), total(F.transform(m, lambda k: k.cast("double"))).alias("t"),
    )
    tokens, diff = F.greatest(F.sum("t"), F.lit(1.0)), F.col("o") - F.col("n")
    return sums.agg(
        F.avg(F.exp(-F.col("n"))).alias("training_ppl"), F.avg(-F.col("n")).alias("training_log_ppl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg(-F.col("o")).alias("rollout_log_ppl"),
        (F.sum(-F.col("ds")) / tokens).alias("kl"), (F.sum("k3") / tokens).alias("k3_kl"), F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"), F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"), (F.sum("r2") / tokens - 1).alias("chi2_token"), (F.avg(safe_exp(F.col("d")) * safe_exp(F.col("d"))) - 1).alias("chi2_seq"),
    )


def weight_metrics(df: DataFrame, weights: str, mask: str, most: float = 2.0) -> DataFrame:
    """Mean weight, effective sample size of weights clamped to [1 / most, most], share of zero weights."""
    w = F.explode(F.arrays_zip(F.col(weights).alias("w"), F.col(mask).alias("m"))).alias("x")
    t = df.select(w).select("x.w", "x.m").where("m > 0")
    c = F.greatest(F.least(F.col("w"), F.lit(most)), F.lit(1 / most))
    out = t.agg(F.avg("w").alias("is_weight_mean"), F.avg(c).alias("mc"), F.avg(c * c).alias("m2"), F.avg((F.col("w") == 0).cast("double")).alias("zero_frac"))
    return out.select("is_weight_mean", (1 / F.greatest(F.col("m2") / ((F.col("mc") + 1e-8) * (F.col("mc") + 1e-8)), F.lit(1e-10))).alias("ess"), "zero_frac")


def _ranked(values: DataFrame, rank: int, lo: float, hi: float, n: int) -> tuple[float, float | None]:
    """The value of a 0-based rank among n values v from lo to hi, and the next one if it is among those read last.

    Rounds of histograms: each cuts the part that holds the rank into BINS, of which the driver reads counts and
    ends, until the part has LAST values at most or only one.
    """
    before = 0
    part = values
    while lo < hi and n > LAST:
        # halves, so that the span is finite for any two finite doubles
        place = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1))
        bins = sorted(part.groupBy(place.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # BINS rows at most
        for b in bins:
            if before + b["n"] > rank:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            before += b["n"]
        part = values.where(F.col("v").between(lo, hi))
    if lo == hi:
        return lo, lo if rank + 1 < before + n else None
    found = sorted(r[0] for r in part.collect())  # LAST values at most
    at = rank - before
    return found[at], found[at + 1] if at + 1 < len(found) else None


def exact_quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """The exact quantile, linear between neighbours; nulls and NaN do not count. None without values.

    No task or driver holds the values: the range that has the rank is narrowed until LAST are left.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank, rest = divmod(q * (n - 1), 1)
    first, after = _ranked(values, int(rank), lo, hi, n)
    if not rest:
        return first
    if after is None:
        after = values.where(F.col("v") > first).agg(F.min("v")).first()[0]
    return first + rest * (after - first)


def entropy_threshold(df: DataFrame, entropy: str, mask: str, top: float) -> DataFrame:
    """The exact quantile (linear between neighbours) above which the top share of tokens lies."""
    t = df.select(F.explode(F.arrays_zip(F.col(entropy).alias("e"), F.col(mask).alias("m"))).alias("x")).where("x.m > 0")
    return df.sparkSession.createDataFrame([(exact_quantile(t, F.col("x.e"), 1 - top),)], "threshold double")


def chord_weight(step: Column, warmup: int, decay: int, peak: float, valley: float) -> Column:
    """A weight that rises to peak, falls to valley along half a cosine, and stays."""
    turn = (step - warmup) / F.lit(float(max(decay, 1)))
    return F.when(step < warmup, step / float(max(warmup, 1)) * peak).when(step >= warmup + decay, F.lit(valley)).otherwise(valley + (peak - valley) * 0.5 * (1 + F.cos(F.pi() * turn)))


def log_softmax(x: Column, temperature: float = 1.0) -> Column:
    norm = lambda z, top: top + F.ln(total(F.transform(z, lambda v: F.exp(v - top))))
    shifted = lambda z, n: F.transform(z, lambda v: v - n)
    return let(lambda z: let(lambda top: let(lambda n: shifted(z, n), norm(z, top)), F.array_max(z)), F.transform(x, lambda v: v / temperature))


def jsd(student: Column, teacher: Column, beta: float = 0.5, temperature: float = 1.0) -> Column:
    """Generalised Jensen-Shannon divergence of two logit vectors: beta * KL(t | m) + (1 - beta) * KL(s | m)."""
    s, t = log_softmax(student, temperature), log_softmax(teacher, temperature)
    kl = lambda p, q: total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))
    if beta == 0:
        return kl(t, s)
    if beta == 1:
        return kl(s, t)
    m = F.zip_with(s, t, lambda a, b: F.ln((1 - beta) * F.exp(a) + beta * F.exp(b)))
    return beta * kl(t, m) + (1 - beta) * kl(s, m)


def grouped_jsd(df: DataFrame, student: str, teacher: str, channel: str, settings: dict[str, tuple[float, float]], default: tuple[float, float] = (0.5, 1.0)) -> DataFrame:
    """Token-weighted divergence where channels have their own (beta, temperature).

    One row a token; tokens are grouped by their settings, each group's mean is weighted by its tokens.
    """
    value = jsd(F.col(student), F.col(teacher), *default)
    for name, (beta, temperature) in settings.items():
        value = F.when(F.col(channel) == name, jsd(F.col(student), F.col(teacher), beta, temperature)).otherwise(value)
    return df.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("loss"), F.count("*").alias("tokens"))


def kl_penalised(reward: Column, new: Column, ref: Column, mask: Column, beta: float) -> Column:
    """A reward less beta times the summed log ratio of the policy to its reference."""
    return reward - beta * total(F.zip_with(log_ratio(new, ref), mask, lambda d, m: d * m))
