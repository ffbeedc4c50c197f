"""Queries over rewards, log-probabilities, rankings and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, policy, tokens
from ..operators import advantage, combine
from .data import WORDS
from .registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


GRP = "select *, avg(value) over (partition by user_id) as m, count(*) over (partition by user_id) as k, coalesce(stddev_samp(value) over (partition by user_id), 0) as s from events"


@query(f"select event_id, (value - m) / (s + 1e-4::double) as advantage from ({GRP})")
def adv_grpo(spark, sf_dir):
    return advantage.advantages(_events(spark, sf_dir), "user_id", "value").select("event_id", "advantage")


@query(f"select event_id, case when k > 1 then (value - m) * k / (k - 1) else value - m end as advantage from ({GRP})")
def adv_rloo(spark, sf_dir):
    return advantage.advantages(_events(spark, sf_dir), "user_id", "value", "rloo", "none").select("event_id", "advantage")


@query(f"with g as ({GRP}) select event_id, (value - m) / ((select stddev_samp(value) from events) + 1e-4::double) as advantage from g")
def adv_batch_scaled(spark, sf_dir):
    return advantage.advantages(_events(spark, sf_dir), "user_id", "value", scale="batch").select("event_id", "advantage")


@query(f"with g as (select *, value - m as a from ({GRP})) select event_id, a / ((select stddev_samp(a) from g) + 1e-4::double) as advantage from g")
def adv_reinforce(spark, sf_dir):
    return advantage.advantages(_events(spark, sf_dir), "user_id", "value", "reinforce_pp", "batch").select("event_id", "advantage")


@query("""with r as (select event_id, user_id, value as a, (event_id % 17)::double as b from events),
z as (select *, (a - avg(a) over w) / (coalesce(stddev_samp(a) over w, 0) + 1e-8::double) as za, (b - avg(b) over w) / (coalesce(stddev_samp(b) over w, 0) + 1e-8::double) as zb from r window w as (partition by user_id)),
t as (select event_id, za * 0.7::double + zb * 0.3::double as s from z) select event_id, (s - (select avg(s) from t)) / ((select stddev_samp(s) from t) + 1e-8::double) as advantage from t""")
def adv_gdpo(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("other", (F.col("event_id") % 17).cast("double"))
    return advantage.gdpo(e, "user_id", ["value", "other"], [0.7, 0.3]).select("event_id", "advantage")


@query("""with q as (select event_id, user_id, event_id // 3 as req, value from events), l as (select req, arg_max(value, event_id) as v, arg_max(user_id, event_id) as u from q group by req),
a as (select req, (v - avg(v) over (partition by u)) / (coalesce(stddev_samp(v) over (partition by u), 0) + 1e-4::double) as advantage from l),
c as (select req, max(value) - min(value) <= 1e-6 as consistent from q group by req) select event_id, advantage, consistent from q join a using (req) join c using (req)""")
def adv_by_request(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("req", F.floor(F.col("event_id") / 3))
    return advantage.by_request(e, "req", "user_id", "value", "event_id").select("event_id", "advantage", "consistent")


@query("with g as (select avg(value) as m, coalesce(stddev_samp(value), 0) as s from events group by user_id) select avg(m) as reward, avg(s) as reward_std, avg((s < 1e-12)::int) as frac_zero_std from g")
def reward_stats(spark, sf_dir):
    return advantage.reward_stats(_events(spark, sf_dir), "user_id", "value")


@query("""with b as (select event_id, user_id, (event_type = 'purchase')::int as r from events), g as (select user_id from b group by user_id having coalesce(stddev_samp(r), 0) > 0 order by min(event_id), user_id limit 5)
select event_id from b where user_id in (select user_id from g)""")
def dynamic_filter(spark, sf_dir):
    b = _events(spark, sf_dir).withColumn("r", (F.col("event_type") == "purchase").cast("int"))
    return advantage.dynamic_batch(b, "user_id", "r", "event_id", 5).select("event_id")


@query("select event_id, coalesce(case when isnan(a) then null else a end, 0) * 0.5::double + coalesce(b, 0) * 2.0::double as total from (select event_id, case when event_id % 5 = 0 then 'nan'::double else value end as a, case when event_id % 7 = 0 then null else event_id::double end as b from events)")
def weighted_rewards(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("a"), F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("double")).alias("b"))
    return e.select("event_id", advantage.weighted_reward(["a", "b"], [0.5, 2.0]).alias("total"))


@query("""select event_id, case when lo = hi then case when value = 0 then 0 else least(1.0::double, value) end else (value - lo) / (hi - lo + 1e-5::double) end as norm
from (select event_id, value, min(value) over (partition by user_id) as lo, max(value) over (partition by user_id) as hi from events)""")
def normalised_scores(spark, sf_dir):
    return advantage.normalised(_events(spark, sf_dir), "user_id", "value", "norm").select("event_id", "norm")


@query("""with c as (select event_id, user_id, (event_type in ('purchase', 'click'))::int::double as o, value as p from events),
n as (select *, case when min(o) over w = max(o) over w then case when o = 0 then 0 else least(1.0::double, o) end else (o - min(o) over w) / (max(o) over w - min(o) over w + 1e-5::double) end as no,
  case when min(p) over w = max(p) over w then case when p = 0 then 0 else least(1.0::double, p) end else (p - min(p) over w) / (max(p) over w - min(p) over w + 1e-5::double) end as np from c window w as (partition by user_id)),
s as (select *, np + 10 * no as score, (no > 0.2::double and np > 0.2::double) as ok from n),
r as (select *, row_number() over (partition by user_id order by score desc, event_id) as k, row_number() over (partition by user_id order by score, event_id desc) = 1 as rejected from s),
f as (select *, ok and k <= 2 and not rejected as positive from r), g as (select *, bool_or(positive) over (partition by user_id) as a, avg(ok::int) over (partition by user_id) as share from f)
select event_id, score, positive, rejected from g where a and share <= 0.9::double and (positive or rejected)""")
def rejection_select(spark, sf_dir):
    c = _events(spark, sf_dir).withColumn("o", F.col("event_type").isin("purchase", "click").cast("double"))
    return advantage.rejection_select(c, "user_id", "event_id", "o", "value", best=2, threshold=0.2, easy=0.9).select("event_id", "score", "positive", "rejected")


@query("with l as (select user_id, arg_max(value, event_id) as v, max(event_id) as e from events group by user_id) select count(*) as samples, sum(floor(v))::bigint as prompt_tokens, sum(e)::bigint as generated_tokens, count(*) / 2.0::double as samples_per_s, sum(e) / 2.0::double as tokens_per_s from l")
def throughput(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", F.floor("value").alias("p"), F.col("event_id").alias("g"))
    return advantage.throughput(e, "user_id", "event_id", "p", "g", 2.0)


# -- log-probabilities: embeddings stand in for them ------------------------------------------------

LP = """select vec_id, list_transform(embedding, lambda x: -abs(x::double)) as n, list_transform(embedding, lambda x: -abs(x::double) * 0.9::double - 0.01::double) as o,
  list_transform(range(1, len(embedding) + 1), lambda i: case when i % 5 = 0 then 0.0::double else 1.0::double end) as m, case when vec_id % 2 = 0 then 1.0::double else -0.5::double end as adv from embeddings"""


def _logps(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("n"), F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 0.9 - 0.01).alias("o"),
        F.transform("embedding", lambda _, i: F.when((i + 1) % 5 == 0, 0.0).otherwise(1.0)).alias("m"), F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(-0.5).alias("adv"),
    )


def _sum(expr: str) -> str:
    return f"list_sum(list_transform(range(1, len(n) + 1), lambda i: {expr}))"


@query(f"""with p as ({LP}) select vec_id, {_sum('-least(exp(n[i] - o[i]) * adv, greatest(least(exp(n[i] - o[i]), 1.2::double), 0.8::double) * adv) * m[i]')} / {_sum('m[i]')} as grpo,
{_sum('-least(exp(n[i] - o[i]), 0.2::double) * adv * n[i] * m[i]')} / {_sum('m[i]')} as cispo,
{_sum("-(case when adv > 0 then 4.0::double / (1 + exp(-(exp(n[i] - o[i]) - 1))) else 4.0::double / 1.05 / (1 + exp(-1.05::double * (exp(n[i] - o[i]) - 1))) end) * adv * m[i]")} / {_sum('m[i]')} as sapo from p""")
def policy_losses(spark, sf_dir):
    """Per-sequence means of clipped, cispo and sapo token losses."""
    p = _logps(spark, sf_dir)
    n, o, m, a = (F.col(c) for c in ("n", "o", "m", "adv"))
    return p.select("vec_id", *[policy.masked_mean(policy.token_losses(n, o, m, a, k), m).alias(k) for k in ("grpo", "cispo", "sapo")])


@query(f"""with p as ({LP}), s as (select {_sum('-least(exp(n[i] - o[i]) * adv, greatest(least(exp(n[i] - o[i]), 1.2::double), 0.8::double) * adv) * m[i]')} as x, {_sum('m[i]')} as t from p)
select avg(x / t) as grpo, sum(x) / sum(t) as bnpo, sum(x) / (count(*) * 64) as dr_grpo from s""")
def policy_batch_losses(spark, sf_dir):
    p = _logps(spark, sf_dir).withColumn("l", policy.token_losses(F.col("n"), F.col("o"), F.col("m"), F.col("adv")))
    out = policy.batch_loss(p, "l", "m", "grpo").withColumnRenamed("loss", "grpo")
    for kind in ("bnpo", "dr_grpo"):
        out = out.join(F.broadcast(policy.batch_loss(p, "l", "m", kind, longest=64).withColumnRenamed("loss", kind)))  # single rows
    return out


@query(f"""with p as ({LP}), s as (select vec_id, n, o, m, exp({_sum('(n[i] - o[i]) * m[i]')} / {_sum('m[i]')}) as g from p)
select vec_id, {_sum('least(exp(n[i] - o[i]), 0.99::double)')} as token_truncate, {_sum('case when exp(n[i] - o[i]) <= 0.99::double then exp(n[i] - o[i]) else 0 end')} as token_mask,
len(n) * least(g, 0.99::double) as sequence_truncate, case when g <= 0.99::double then {_sum('exp(n[i] - o[i])')} else 0 end as sequence_mask from s""")
def rollout_weights(spark, sf_dir):
    p = _logps(spark, sf_dir).withColumn("r", policy.log_ratio(F.col("n"), F.col("o")))
    return p.select("vec_id", *[policy.total(policy.rollout_weights(F.col("r"), F.col("m"), k, 0.99)).alias(k) for k in ("token_truncate", "token_mask", "sequence_truncate", "sequence_mask")])


@query(f"with p as ({LP}) select vec_id, not ({_sum('(o[i] - n[i]) * m[i]')} / {_sum('m[i]')} > -0.0005::double and adv < 0) as kept from p")
def sequence_mask(spark, sf_dir):
    p = _logps(spark, sf_dir)
    return p.select("vec_id", policy.off_policy_kept(F.col("n"), F.col("o"), F.col("m"), F.col("adv"), -0.0005).alias("kept"))


@query(f"""with p as ({LP}), s as (select {_sum('n[i] * m[i]')} / {_sum('m[i]')} as mn, {_sum('o[i] * m[i]')} / {_sum('m[i]')} as mo, {_sum('(n[i] - o[i]) * m[i]')} as ds, {_sum('m[i]')} as t,
  {_sum('(exp((n[i] - o[i]) * m[i]) - (n[i] - o[i]) * m[i] - 1) * m[i]')} as k3, {_sum('exp(2 * (n[i] - o[i]) * m[i]) * m[i]')} as r2 from p)
select avg(exp(-mn)) as training_ppl, avg(-mn) as training_log_ppl, avg(exp(-mo)) as rollout_ppl, avg(-mo) as rollout_log_ppl, sum(-ds) / sum(t) as kl, sum(k3) / sum(t) as k3_kl, avg(mo - mn) as log_ppl_diff, avg(abs(mo - mn)) as log_ppl_abs_diff,
max(mo - mn) as log_ppl_diff_max, min(mo - mn) as log_ppl_diff_min, avg(exp(mo - mn)) as ppl_ratio, sum(r2) / sum(t) - 1 as chi2_token, avg(exp(2 * ds / t)) - 1 as chi2_seq from s""")
def off_policy_metrics(spark, sf_dir):
    return policy.off_policy_metrics(_logps(spark, sf_dir), "n", "o", "m")


@query(f"""with p as ({LP}), w as (select unnest(list_transform(list_filter(range(1, len(n) + 1), lambda i: m[i] > 0), lambda i: case when exp(n[i] - o[i]) <= 1.0::double then exp(n[i] - o[i]) else 0 end)) as w from p),
c as (select w, greatest(least(w, 1.0::double), 1.0::double) as c from w) select avg(w) as is_weight_mean, 1 / greatest(avg(c * c) / ((avg(c) + 1e-8::double) * (avg(c) + 1e-8::double)), 1e-10::double) as ess, avg((w = 0)::int) as zero_frac from c""")
def weight_metrics(spark, sf_dir):
    p = _logps(spark, sf_dir)
    p = p.withColumn("w", policy.rollout_weights(policy.log_ratio(F.col("n"), F.col("o")), F.col("m"), "token_mask", 1.0))
    return policy.weight_metrics(p, "w", "m", 1.0)


@query(f"with p as ({LP}) select quantile_cont(e, 0.8::double) as threshold from (select unnest(list_transform(list_filter(range(1, len(n) + 1), lambda i: m[i] > 0), lambda i: n[i])) as e from p)")
def entropy_threshold(spark, sf_dir):
    return policy.entropy_threshold(_logps(spark, sf_dir), "n", "m", 0.2)


@query("select doc_id, case when doc_id < 100 then doc_id / 100.0::double * 0.9::double when doc_id >= 500 then 0.05::double else 0.05::double + (0.9::double - 0.05) * 0.5 * (1 + cos(pi() * (doc_id - 100) / 400.0::double)) end as weight from documents")
def weight_schedule(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", policy.chord_weight(F.col("doc_id"), 100, 400, 0.9, 0.05).alias("weight"))


@query("""with v as (select a.vec_id, a.embedding as s, b.embedding as t from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
l as (select vec_id, list_transform(s, lambda x: x::double - ln(list_sum(list_transform(s, lambda y: exp(y::double))))) as s, list_transform(t, lambda x: x::double - ln(list_sum(list_transform(t, lambda y: exp(y::double))))) as t from v),
m as (select *, list_transform(range(1, len(s) + 1), lambda i: ln(0.7::double * exp(s[i]) + 0.3::double * exp(t[i]))) as m from l)
select vec_id, 0.3::double * list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(t[i]) * (t[i] - m[i]))) + 0.7::double * list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(s[i]) * (s[i] - m[i]))) as jsd from m""")
def distill_jsd(spark, sf_dir):
    """Generalised divergence of neighbouring vectors read as logits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    return e.join(t, "vec_id").select("vec_id", policy.jsd(F.col("s"), F.col("t"), 0.3).alias("jsd"))


# -- metrics ---------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label")), "vec_id")


DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::double * b[i]::double))"
PAIRS = "select x.vec_id, x.embedding as a, y.embedding as b, (x.label = y.label)::int as y from embeddings x join embeddings y on y.vec_id = x.vec_id + 1"


@query(f"select vec_id, {DOT} / (sqrt({DOT.replace('b[i]', 'a[i]')}) * sqrt({DOT.replace('a[i]', 'b[i]')})) as cosine, -list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i]::double - b[i]::double))) as manhattan, -sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::double - b[i]::double) * (a[i]::double - b[i]::double)))) as euclidean, {DOT} as dot from ({PAIRS})")
def pair_similarity(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("vec_id", *[c.alias(k) for k, c in metrics.similarities(F.col("embedding"), F.col("other")).items()])


@query("""with r as (select value as x, event_id % 50 as y from events), k as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry from r)
select corr(x, y) as pearson, corr(rx, ry) as spearman from k""")
def rank_correlation(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return metrics.correlations(e, "x", "y")


@query("""with g as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id) as grp, (event_type = 'purchase')::int as label from events), f as (select * from g where grp > 0),
r as (select *, row_number() over (partition by user_id, grp order by value desc, event_id) as r, row_number() over (partition by user_id, grp order by event_id) as f, row_number() over (partition by user_id, grp order by label desc, event_id) as i from f),
p as (select user_id, grp, count(*) as n, max(case when f = 1 then 1.0::double / r end) as rr, sum((2.0::double ** label - 1) / log2(r + 1.0::double)) as dcg, sum((2.0::double ** label - 1) / log2(i + 1.0::double)) as idcg from r group by user_id, grp having count(*) >= 2)
select avg(rr) as mrr, avg(case when idcg > 0 then dcg / idcg else 0 end) as ndcg from p""")
def mrr_ndcg(spark, sf_dir):
    """Groups start at a purchase; the purchase is the relevant row."""
    e = _events(spark, sf_dir).withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    g = metrics.label_groups(e, "event_id", "label", by="user_id")
    return metrics.ranking_metrics(g, ["user_id", "grp"], "event_id", "value", "label")


@query("select avg((quality = toxic)::int) as acc from labels")
def exact_match(spark, sf_dir):
    return metrics.exact_match(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))


@query("""with t as (select doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: ('0x' || md5(w)[1:7])::bigint % 5) as x from documents),
h as (select doc_id, list_filter(range(2, len(x) + 1), lambda i: x[i] <> 4) as k, x from t), s as (select len(k) as n, len(list_filter(k, lambda i: x[i - 1] = x[i])) as c from h)
select sum(c) / sum(n)::double as token_acc, avg((c = n)::int) as seq_acc from s where n > 0""")
def token_accuracy(spark, sf_dir):
    """Each token predicts the next one; tokens of value 4 are masked."""
    d = table(spark, sf_dir, "documents").select(F.transform(tokens.words(F.col("text")), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % 5).cast("int")).alias("t"))
    d = d.select("t", F.transform("t", lambda x: F.when(x == 4, tokens.MASKED).otherwise(x)).alias("l"))
    return metrics.token_accuracy(d, "t", "l")


@query("select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as top, embedding[1] > 0 and embedding[2] <= 0 as both from embeddings")
def class_outputs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", metrics.argmax(F.col("embedding")).alias("top"), metrics.multilabel_right(F.slice("embedding", 1, 2), F.array(F.lit(1), F.lit(0))).alias("both"))


@query(f"""with p as (select vec_id // 16 as batch, vec_id, a, b from ({PAIRS})), s as (select p.batch, p.vec_id, p.vec_id = q.vec_id as own, list_sum(list_transform(range(1, len(p.a) + 1), lambda i: p.a[i]::double * q.b[i]::double)) as s from p join p q on p.batch = q.batch),
k as (select batch, vec_id, max(case when own then s end) as pos, avg(case when not own then s end) as neg, max(case when not own then s end) as hard, sum(exp(s / 0.1::double)) as z from s group by batch, vec_id)
select batch, avg(pos) as mean_pos, avg(neg) as mean_neg, avg(pos - hard) as margin, avg(ln(z) - pos / 0.1::double) as loss from k group by batch""")
def infonce(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 16))
    return metrics.infonce_stats(p, "batch", "embedding", "other", "vec_id")


DOTS = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::double * {1}[i]::double))"


@query(f"""with p as (select vec_id // 16 as batch, vec_id, a, b from ({PAIRS})),
s as (select p.batch, p.vec_id, p.vec_id = q.vec_id as own, {DOTS.format('p.a', 'q.b')} as qd, {DOTS.format('p.a', 'q.a')} as qq, {DOTS.format('p.b', 'q.b')} as dd from p join p q on p.batch = q.batch),
t as (select *, max(case when own then qd end) over (partition by vec_id) as pos from s),
k as (select vec_id, any_value(pos) as pos, max(greatest(qd, qq, dd)) as top from t group by vec_id)
select t.vec_id, ln(sum(exp((pos - top) / 0.1::double) * own::int + case when own then 0 else exp((dd - top) / 0.1::double) + case when qd <= pos + 0.1::double then exp((qd - top) / 0.1::double) else 0 end + case when qq <= pos + 0.1::double then exp((qq - top) / 0.1::double) else 0 end end)) + (any_value(top) - any_value(pos)) / 0.1::double as loss
from t join (select vec_id, top from k) using (vec_id) group by t.vec_id""")
def infonce_terms(spark, sf_dir):
    """Loss of each pair against the documents and queries of its batch, and of its document against the others."""
    p = _pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 16))
    return metrics.infonce_terms(p, "batch", "embedding", "other", "vec_id", 0.1, 0.1)


@query(f"""with d as (select y, {DOT} / (sqrt({DOT.replace('b[i]', 'a[i]')}) * sqrt({DOT.replace('a[i]', 'b[i]')})) as c from ({PAIRS})), e as (select y, c, 1 - c as d from d),
t as (select max(case when y = 1 then d end) as pmax, min(case when y = 0 then d end) as nmin from e)
select avg((c - y) * (c - y)) as cosine_mse, avg(0.5::double * (y * d * d + (1 - y) * greatest(0.5::double - d, 0) * greatest(0.5::double - d, 0))) as contrastive,
sum(case when y = 1 and d > (select nmin from t) then d * d else 0 end) + sum(case when y = 0 and d < (select pmax from t) then greatest(0.5::double - d, 0) ** 2 else 0 end) as online_contrastive from e""")
def pair_losses(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("y", (F.col("label") == F.col("other_label")).cast("int"))
    return metrics.pair_losses(p, "embedding", "other", "y")


@query("""with g as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id) as grp from events), p as (select user_id, grp, arg_min(value, event_id) as f, ln(sum(exp((value) / 100.0::double))) as z from g where grp > 0 group by user_id, grp having count(*) >= 2)
select avg(z - f / 100.0::double) as loss from p""")
def listwise_ce(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return metrics.listwise_ce(metrics.label_groups(e, "event_id", "label", by="user_id"), ["user_id", "grp"], "event_id", "value", temperature=100.0)


@query("select avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))) as loss from (select value / 50.0::double as s, (event_type = 'purchase')::int as y from events)")
def pointwise_bce(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.agg(F.avg(metrics.pointwise_bce(F.col("value") / 50, (F.col("event_type") == "purchase").cast("int"))).alias("loss"))


@query("select source, avg(n_chars::double) as loss from documents group by source")
def channel_loss(spark, sf_dir):
    """Mean loss of each channel; text length stands for the loss."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(metrics.mean_or(F.col("n_chars").cast("double")).alias("loss"))


@query("""select vec_id, ln(list_sum(list_transform(embedding, lambda x: exp(x::double)))) - embedding[label + 1]::double as nll from embeddings""")
def token_nll(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", metrics.token_nll(F.transform("embedding", lambda x: x.cast("double")), F.col("label")).alias("nll"))


NG = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"


@query(f"""with c as (select conv_id, turn, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from conversations), p as (select a.conv_id, a.turn, a.w as a, b.w as b from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, case when len(a) + len(b) > 0 then 2.0::double * len(list_intersect(list_distinct(a), list_distinct(b))) / (len(list_distinct(a)) + len(list_distinct(b))) else 0 end as rouge1,
case when len({NG.format('a')}) + len({NG.format('b')}) > 0 then 2.0::double * len(list_intersect({NG.format('a')}, {NG.format('b')})) / (len({NG.format('a')}) + len({NG.format('b')})) else 0 end as rouge2 from p""")
def rouge(spark, sf_dir):
    """ROUGE-1 and -2 of each turn against the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.words(F.col("text")).alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return p.select("conv_id", "turn", metrics.rouge_n(F.col("a"), F.col("b"), 1).alias("rouge1"), metrics.rouge_n(F.col("a"), F.col("b"), 2).alias("rouge2"))


def _grams(words: str, k: int) -> str:
    return f"case when len({words}) < {k} then []::varchar[] else list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i : i + {k - 1}], ' ')) end"


def _precision(k: int) -> str:
    hits = f"coalesce(list_sum(list_transform(list_distinct(a{k}), lambda g: least(len(list_filter(a{k}, lambda x: x = g)), len(list_filter(b{k}, lambda x: x = g))))), 0)"
    return f"ln(greatest(({hits} + {int(k > 1)})::double / greatest(len(a{k}) + {int(k > 1)}, 1), 1e-12::double)) / 4"


@query(f"""with recursive c as (select conv_id, turn, {WORDS} as a from conversations), p as (select x.conv_id, x.turn, x.a, y.a as b from c x join c y on x.conv_id = y.conv_id and y.turn = x.turn + 1),
table_ as (select conv_id, turn, 0 as i, list_transform(range(len(b) + 1), lambda j: 0) as r from p union all
  select r.conv_id, r.turn, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when k > 1 and b[k - 1] = a[i + 1] then r[k - 1] + 1 else r[k] end))) from table_ r join p using (conv_id, turn) where i < len(a)),
g as (select *, {", ".join(f"{_grams(x, k)} as {x}{k}" for k in range(1, 5) for x in "ab")} from p)
select conv_id, turn, case when len(a) > 0 and len(b) > 0 then 2.0::double * r[len(b) + 1] / (len(a) + len(b)) else 0.0 end as rouge_l,
case when len(a) = 0 then 0.0 else exp({" + ".join(map(_precision, range(1, 5)))} + least(0.0::double, 1 - len(b)::double / greatest(len(a), 1))) end as bleu from g join table_ using (conv_id, turn) where i = len(a)""")
def rouge_l_bleu(spark, sf_dir):
    """ROUGE-L and BLEU-4 of each turn against the next; SQL fills the table of subsequences row by row."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.words(F.col("text")).alias("a"))
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])
    return p.select("conv_id", "turn", metrics.rouge_l(F.col("a"), F.col("b")).alias("rouge_l"), metrics.bleu(F.col("a"), F.col("b")).alias("bleu"))


@query("""with v as (select a.vec_id, a.label, list_transform(a.embedding, lambda x: x::double / case when a.label = 1 then 2.0::double else 1.0::double end) as s, list_transform(b.embedding, lambda x: x::double / case when a.label = 1 then 2.0::double else 1.0::double end) as t from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
l as (select label, list_transform(s, lambda x: x - ln(list_sum(list_transform(s, lambda y: exp(y))))) as s, list_transform(t, lambda x: x - ln(list_sum(list_transform(t, lambda y: exp(y))))) as t from v),
m as (select *, case when label = 1 then 0.2::double else 0.5::double end as b from l), k as (select *, list_transform(range(1, len(s) + 1), lambda i: ln((1 - b) * exp(s[i]) + b * exp(t[i]))) as m from m)
select avg(b * list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(t[i]) * (t[i] - m[i]))) + (1 - b) * list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(s[i]) * (s[i] - m[i])))) as loss, count(*) as tokens from k""")
def grouped_jsd(spark, sf_dir):
    """Divergence with settings by channel; the label is the channel."""
    p = _pairs(spark, sf_dir).select(F.col("label").cast("string").alias("c"), F.transform("embedding", lambda x: x.cast("double")).alias("s"), F.transform("other", lambda x: x.cast("double")).alias("t"))
    return policy.grouped_jsd(p, "s", "t", "c", {"1": (0.2, 2.0)})


@query(f"with p as ({LP}) select vec_id, adv - 0.1::double * {_sum('(n[i] - o[i]) * m[i]')} as reward from p")
def kl_penalised(spark, sf_dir):
    p = _logps(spark, sf_dir)
    return p.select("vec_id", policy.kl_penalised(F.col("adv"), F.col("n"), F.col("o"), F.col("m"), 0.1).alias("reward"))


@query("select d.doc_id, s.seq, e.value from documents d, (select unnest(range(2)) as seq) s left join events e on e.event_id = d.doc_id * 2 + s.seq and e.event_type <> 'error'")
def realigned_responses(spark, sf_dir):
    """Two responses for every request, null where one failed."""
    requests = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("seq"))
    back = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.floor(F.col("event_id") / 2).alias("doc_id"), (F.col("event_id") % 2).alias("seq"), "value")
    return combine.realigned(requests, back, "doc_id", "seq", "value")


@query("select vec_id, least(7, n)::bigint as kinds, case when n = 0 then 0 else 7 end::bigint as size from (select vec_id, vec_id % 10 as n from embeddings) where n = 0 or n >= 7 union all select vec_id, n, 7 from (select vec_id, vec_id % 10 as n from embeddings) where n > 0 and n < 7")
def trimmed_negatives(spark, sf_dir):
    """Seven negatives for every anchor that has any; missing ones are drawn again."""
    n = (F.col("vec_id") % 10).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < n).alias("neg"))
    t = e.select("vec_id", metrics.trimmed_negatives(F.col("neg"), 7, F.col("vec_id")).alias("t"))
    return t.select("vec_id", F.size(F.array_distinct("t")).cast("long").alias("kinds"), F.size("t").cast("long").alias("size"))
