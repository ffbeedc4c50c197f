"""Queries over documents, events and orders: sampling, splitting, packing, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render, rewards, tokens
from ..operators import combine, expand, filters, packing, recipes, sampling
from .registry import query, table

WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
IDS = f"list_transform({WORDS}, lambda w: ('0x' || md5(w)[1:7])::bigint % 1048576)"


def _docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def _ids(spark, sf_dir):
    return _docs(spark, sf_dir, "source", tokens.token_ids(F.col("text")).alias("ids"))


def _order(seed: str, key: str) -> str:
    return f"row_number() over (order by md5('{seed}:' || {key}), {key})"


# -- sampling ----------------------------------------------------------------------------------


@query(f"select doc_id from (select doc_id, {_order('sample', 'doc_id')} as r from documents) where r <= 137")
def sample_n(spark, sf_dir):
    return sampling.sample(_docs(spark, sf_dir), 137, "doc_id").select("doc_id")


@query(f"with s as (select vec_id, {_order('sample', 'vec_id')} as r, count(*) over () as n from embeddings) select vec_id, 2 + (r <= 10)::bigint as copies from s")
def sample_repeat(spark, sf_dir):
    """More rows than there are: the whole table twice and ten rows a third time."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return sampling.sample(e, 2 * e.count() + 10, "vec_id").groupBy("vec_id").agg(F.count("*").alias("copies"))


@query(f"select doc_id, case when r <= n // 10 then 'val' else 'train' end as part from (select doc_id, {_order('split', 'doc_id')} as r, count(*) over () as n from documents)")
def split_ratio(spark, sf_dir):
    return sampling.split(_docs(spark, sf_dir), 0.1, "doc_id").select("doc_id", "part")


@query("select doc_id, case when r < 20 then 'val' else 'train' end as part from (select doc_id, row_number() over (order by doc_id) - 1 as r from documents) where r < 150")
def split_stream(spark, sf_dir):
    return sampling.take_skip(_docs(spark, sf_dir), "doc_id", 150, 20)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders) where r >= n * 2 // 7 and r < n * 3 // 7")
def shard_contiguous(spark, sf_dir):
    return sampling.shard(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 2)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) where r % 7 = 2")
def shard_strided(spark, sf_dir):
    return sampling.shard(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 2, contiguous=False)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () // 7 as s from orders) where r >= s * 6 and r < s * 7")
def piece(spark, sf_dir):
    return sampling.piece(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 6)


@query("select doc_id, (row_number() over (order by doc_id) - 1) % 3 as worker, ntile(7) over (order by doc_id) - 1 as part from documents")
def round_robin_and_even(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return sampling.round_robin(d, "doc_id", 3).join(sampling.even_split(d, "doc_id", 7), "doc_id")


@query(f"select doc_id, r // 32 as batch_id, r % 4 as rank from (select doc_id, {_order('epoch1', 'doc_id')} - 1 as r, count(*) over () as n from documents) where r < n // 32 * 32 and r // 32 >= 2")
def batch_sampler(spark, sf_dir):
    """Strided batches of 8 on 4 ranks in the second epoch, after 64 rows were consumed."""
    return sampling.batches(_docs(spark, sf_dir), "doc_id", 8, 4, epoch=1, consumed=64).select("doc_id", "batch_id", "rank")


@query(f"select doc_id, r // b as rank, (r % b) // 8 as batch_id from (select doc_id, {_order('epoch0', 'doc_id')} - 1 as r, count(*) over () // 32 * 32 // 4 as b from documents) where r < b * 4")
def batch_sampler_sharded(spark, sf_dir):
    return sampling.batches(_docs(spark, sf_dir), "doc_id", 8, 4, sharded=True).select("doc_id", "rank", "batch_id")


@query(f"""with s as (select doc_id, n_chars, {_order('group', 'doc_id')} - 1 as r from documents)
select doc_id, r // 64 * 8 + (row_number() over (partition by r // 64 order by n_chars desc, r) - 1) // 8 as batch_id from s""")
def length_grouped(spark, sf_dir):
    return sampling.length_batches(_docs(spark, sf_dir, "n_chars"), "doc_id", "n_chars", 8, mega=8).select("doc_id", F.col("batch_id").cast("long").alias("batch_id"))


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def last_per_key(spark, sf_dir):
    return sampling.last_by(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("""select event_id, row_number() over (partition by user_id order by value desc, event_id) as rank, row_number() over (partition by user_id order by value desc, event_id) <= 2 as best,
row_number() over (partition by user_id order by value, event_id desc) = 1 as worst from events""")
def best_worst(spark, sf_dir):
    return sampling.best_worst(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 2).select("event_id", F.col("rank").cast("long").alias("rank"), "best", "worst")


@query("select doc_id, list_transform(range(4), lambda i: floor(n_chars / 4.0::double * i + n_chars / 4.0::double / 2)::int) as frames from documents")
def frames(spark, sf_dir):
    return _docs(spark, sf_dir, sampling.frame_indices(F.col("n_chars"), 4).alias("frames"))


@query("""with g as (select x, y, row_number() over (order by x * y, x, y) as o from (select unnest(range(1, 7)) as x) a, (select unnest(range(1, 7)) as y) b where x * y <= 6),
c as (select doc_id, x, y, o, abs((n_chars % 900 + 100)::double / 448 - x::double / y) as d, (n_chars % 900 + 100) * 448 as area from documents, g),
m as (select doc_id, min(d) as d from c group by doc_id), t as (select c.*, row_number() over (partition by c.doc_id order by o) as k from c join m on c.doc_id = m.doc_id and c.d = m.d)
select doc_id, arg_max(x, o)::int as x, arg_max(y, o)::int as y from t where k = 1 or area > 0.5::double * 448 * 448 * x * y group by doc_id""")
def tiles(spark, sf_dir):
    """Tile grids; sizes are made of n_chars."""
    g = sampling.tile_grid(F.col("n_chars") % 900 + 100, F.lit(448), 448, 1, 6)
    return _docs(spark, sf_dir, g.alias("g")).select("doc_id", "g.x", "g.y")


# -- combining -----------------------------------------------------------------------------------


WEIGHTS = {"en": 0.5, "fr": 0.3, "de": 0.2}
LINE = """l as (select doc_id, lang, w, row_number() over (partition by lang order by md5('interleave:' || doc_id), doc_id) - 1 as pos
  from documents join (values ('en', 0.5::double), ('fr', 0.3::double), ('de', 0.2::double)) t(k, w) on lang = k), e as (select lang, w, count(*) as n from l group by lang, w)"""


@query(f"with {LINE} select doc_id, (pos + 0.5::double) / w as place from l where (pos + 0.5::double) / w <= (select min(n / w) from e)")
def interleave_first(spark, sf_dir):
    return combine.interleave(_docs(spark, sf_dir, "lang"), "lang", "doc_id", WEIGHTS).select("doc_id", "place")


@query(f"""with {LINE}, x as (select l.doc_id, l.w, l.pos, e.n, greatest(ceil((select max(n / w) from e) * e.w / e.n), 1)::int as k from l join e on l.lang = e.lang),
c as (select doc_id, (pos + t * n + 0.5::double) / w as place from (select *, unnest(range(k)) as t from x)) select doc_id, place from c where place <= (select max(n / w) from e)""")
def interleave_all(spark, sf_dir):
    return combine.interleave(_docs(spark, sf_dir, "lang"), "lang", "doc_id", WEIGHTS, "all_exhausted").select("doc_id", "place")


@query("select doc_id, dense_rank() over (order by f) - 1 as group_id from documents join (select source as s, min(doc_id) as f from documents group by source) on source = s")
def dense_groups(spark, sf_dir):
    return combine.dense_ids(_docs(spark, sf_dir, "source"), "source", "doc_id").select("doc_id", F.col("group_id").cast("long").alias("group_id"))


@query("select doc_id, coalesce(c.n, 0) as cached, coalesce(c.n, 0) = 2 as hit from documents d left join (select user_id, count(*) as n from events where event_type = 'view' group by user_id) c on d.doc_id = c.user_id")
def cache_hits(spark, sf_dir):
    """Which rows a cache of results answers in full."""
    cache = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("doc_id"))
    return combine.cache_probe(_docs(spark, sf_dir), cache, "doc_id", 2).select("doc_id", "cached", "hit")


@query("select doc_id, case source when 'src1' then 1 when 'src2' then 2 else 0 end as route from documents")
def channel_route(spark, sf_dir):
    return combine.route(_docs(spark, sf_dir, "source"), "source", {"src1": 1, "src2": 2}).select("doc_id", "route")


@query("""select doc_id, coalesce(lag(md5(text)) over (partition by doc_id // 16 order by doc_id), last_value(md5(text)) over (partition by doc_id // 16 order by doc_id rows between unbounded preceding and unbounded following)) as shifted from documents""")
def shifted_pairs(spark, sf_dir):
    d = _docs(spark, sf_dir, F.md5("text").alias("h"), F.floor(F.col("doc_id") / 16).alias("batch"))
    return combine.shifted_pairs(d, "batch", "doc_id", "h").select("doc_id", "shifted")


@query("""with c as (select sum(quality)::bigint as d, sum(1 - quality)::bigint as u from labels) select d as desirable, u as undesirable, round(greatest(u, 1) / greatest(d, 1)::double, 2) as des_low, round(greatest(u, 1) * 1.33::double / greatest(d, 1), 2) as des_high,
round(greatest(d, 1) / (greatest(u, 1) * 1.33::double), 2) as und_low, round(greatest(d, 1) / greatest(u, 1)::double, 2) as und_high from c""")
def desirability_weights(spark, sf_dir):
    return combine.desirability_weights(table(spark, sf_dir, "labels"), "quality")


@query("select event_id, event_type = 'error' as is_truncated, d.lang from events e join documents d on e.user_id = d.doc_id")
def rollout_merge(spark, sf_dir):
    """Outputs joined back to the inputs of their request."""
    outputs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("request_id"), F.when(F.col("event_type") == "error", "length").otherwise("stop").alias("finish_reason"))
    return combine.merge_outputs(_docs(spark, sf_dir, "lang").withColumnRenamed("doc_id", "request_id"), outputs).select("event_id", "is_truncated", "lang")


@query("select doc_id, count(*) as n, md5(string_agg(event_id::varchar, ',' order by event_id)) as digest from documents join events on doc_id = user_id group by doc_id")
def request_members(spark, sf_dir):
    """All rows of the requests that are asked for."""
    wanted = _docs(spark, sf_dir)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "value")
    m = combine.members(wanted, rows, "doc_id", "event_id", ["value"])
    return m.select("doc_id", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",")).alias("digest"))


# -- expanding -------------------------------------------------------------------------------------


@query("select user_id, session, count(*) as n, min(event_id) as first_id from (select user_id, event_id, sum((event_type = 'signup')::int) over (partition by user_id order by event_id)::bigint as session from events) where session > 0 group by user_id, session")
def sessionise(spark, sf_dir):
    s = expand.sessions(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "signup")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"with t as (select doc_id, {IDS} as ids from documents) select doc_id, c as chunk, len(ids[c * 256 + 1 : c * 256 + 256])::bigint as n, list_sum(ids[c * 256 + 1 : c * 256 + 256])::bigint as total, -100 as first_label from (select *, unnest(range((len(ids) + 255) // 256)) as c from t)")
def doc_chunks(spark, sf_dir):
    d = expand.chunks(_ids(spark, sf_dir).withColumn("labels", F.col("ids")), "ids", 256, "labels")
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.get("labels", 0).alias("first_label"))


@query(f"""with t as (select doc_id, unnest({IDS}) as id, generate_subscripts({WORDS}, 1) as i from documents), o as (select id, row_number() over (order by doc_id, i) - 1 as p, count(*) over () as n from t)
select p // 512 as block, count(*) as n, sum(id)::bigint as total from o where p < n // 512 * 512 group by block""")
def doc_blocks(spark, sf_dir):
    """All token ids in one line, cut into blocks of 512."""
    b = packing.blocks(_ids(spark, sf_dir), "doc_id", "ids", 512)
    return b.select("block", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("select doc_id, 0 as kind, lang as answer from documents where lang is not null union all select doc_id, 1, source from documents where source is not null")
def paired_answers(spark, sf_dir):
    got = expand.paired_answers(_docs(spark, sf_dir, "lang", "source"), "doc_id", {"0": "lang", "1": "source"})
    return got.select("doc_id", F.col("kind").cast("int").alias("kind"), "answer")


@query("""with r as (select doc_id, b, t.r, c.c from (select doc_id, doc_id // 8 as b from documents), (select unnest(range(2)) as r) t, (select unnest(range(3)) as c) c) select doc_id, ((b * 2 + r) * 8 + doc_id % 8) * 3 + c as place from r""")
def repeat_sampler(spark, sf_dir):
    return expand.repeat_sampler(_docs(spark, sf_dir), "doc_id", 3, 8, 2).select("doc_id", "place")


# -- lengths and packing -----------------------------------------------------------------------------


@query(f"select source, avg(n) as mean, stddev_pop(n) as std, min(n)::bigint as min, max(n)::bigint as max, count(*) as size from (select source, len({WORDS}) as n from documents) group by source")
def length_stats(spark, sf_dir):
    d = _docs(spark, sf_dir, "source", F.size(tokens.words(F.col("text"))).cast("long").alias("n"))
    return packing.length_stats(d, F.col("n"), ["source"])


@query(f"select doc_id from documents where len({WORDS}) <= 300")
def length_filter(spark, sf_dir):
    d = _docs(spark, sf_dir, F.array(F.size(tokens.words(F.col("text"))), F.lit(1)).alias("length"))
    return filters.by_length(d, 300).select("doc_id")


def _cut(side: str):
    return f"""with t as (select doc_id, {IDS} as ids from documents) select doc_id, least(len(ids), 100)::bigint as n, list_sum({'ids[1:100]' if side == 'right' else 'ids[greatest(len(ids) - 99, 1) : len(ids)]'})::bigint as total from t where len(ids) > 0"""


def _truncated(spark, sf_dir, side):
    d = _ids(spark, sf_dir).where(F.size("ids") > 0)
    t = d.select("doc_id", tokens.truncated(F.col("ids"), F.col("ids"), 100, side).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(_cut("right"))
def truncate_right(spark, sf_dir):
    return _truncated(spark, sf_dir, "right")


@query(_cut("left"))
def truncate_left(spark, sf_dir):
    return _truncated(spark, sf_dir, "left")


@query()
def pack_bins(spark, sf_dir):
    """Documents packed into 4096 tokens; every id once, no bin over the volume but single rows."""
    d = _docs(spark, sf_dir, F.size(tokens.words(F.col("text"))).cast("long").alias("n"))
    return packing.pack(d, "doc_id", "n", 4096)


@query(f"select count(*) as rows, sum(len({WORDS}))::bigint as tokens from documents")
def pack_totals(spark, sf_dir):
    """What the packs hold in all: nothing is lost or doubled."""
    p = pack_bins(spark, sf_dir)
    return p.agg(F.sum(F.size("members")).cast("long").alias("rows"), F.sum("total").cast("long").alias("tokens"))


@query(f"select doc_id, len({WORDS})::bigint as n, (len({WORDS}) * (len({WORDS}) - 1) // 2)::bigint as positions from documents")
def packed_positions(spark, sf_dir):
    """Position ids of packs count every member from 0; their sum by member is known."""
    ids = _ids(spark, sf_dir).select("doc_id", F.array(F.size("ids").cast("long"), F.lit(3).cast("long")).alias("l"))
    p = ids.select("doc_id", F.get("l", 0).alias("n"), packing.packed_positions(F.col("l")).alias("p"))
    return p.select("doc_id", "n", (F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x) - 3).alias("positions"))


@query(f"""with t as (select doc_id, doc_id // 8 as b, {IDS} as ids from documents) select doc_id, max(len(ids)) over (partition by b)::bigint as padded, list_sum(ids)::bigint as total, (max(len(ids)) over (partition by b) - len(ids))::bigint as masked from t where len(ids) > 0""")
def collate(spark, sf_dir):
    """Batches of 8 padded to their longest row."""
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")  # on the text: a filter on the ids would hash every word twice
    d = table(spark, sf_dir, "documents").where(some).select("doc_id", tokens.token_ids(F.col("text")).alias("ids")).withColumn("labels", F.col("ids")).withColumn("batch", F.floor(F.col("doc_id") / 8))
    c = tokens.collate(d, "batch", "ids", "labels")
    return c.select("doc_id", F.size("ids").cast("long").alias("padded"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("labels", lambda x: x == tokens.MASKED)).cast("long").alias("masked"))


@query(f"select doc_id, len(list_filter(range(1, len(ids) + 1), lambda i: i > 1 and ids[i] % 2 = 0))::bigint as open from (select doc_id, {IDS} as ids from documents) where len(ids) > 0")
def label_mask(spark, sf_dir):
    """Labels with even tokens open and the first always masked."""
    d = _ids(spark, sf_dir).where(F.size("ids") > 0)
    m = d.select("doc_id", tokens.masked_labels(F.col("ids"), F.transform("ids", lambda t: F.when(t % 2 == 0, 1.0).otherwise(0.0))).alias("m"))
    return m.select("doc_id", F.size(F.filter("m", lambda x: x != tokens.MASKED)).cast("long").alias("open"))


@query("""with pool as (select text, row_number() over (order by md5('negatives:' || text), text) - 1 as p, count(*) over () as n from (select distinct text from benchmark)),
w as (select item_id, text, ('0x' || md5('negatives:' || item_id)[1:8])::bigint as s, (select max(n) from pool) as n from benchmark), k as (select *, unnest(range(least(14, n))) as k from w),
f as (select item_id, k, p.text as neg, row_number() over (partition by item_id order by k) as r from k join pool p on p.p = (k.s + k.k) % k.n where p.text <> k.text)
select item_id, count(*) as n, md5(string_agg(neg, '|' order by r)) as digest from f where r <= 7 group by item_id""")
def sampled_negatives(spark, sf_dir):
    """Up to seven answers of other rows for every benchmark item; none is its own."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array("text").alias("answers"))
    got = recipes.sampled_negatives(b, "item_id", "answers")
    return got.select("item_id", F.size("negatives").cast("long").alias("n"), F.md5(F.array_join("negatives", "|")).alias("digest"))


# -- rewards -----------------------------------------------------------------------------------------


@query(f"""with w as (select doc_id, len({WORDS}) as n, list_transform({WORDS.replace('text', 'lower(text)')}, lambda x: x) as ws from documents),
g as (select doc_id, n, list_transform(range(1, n - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) as t from w) select doc_id, case when n < 3 then 0.0::double else -(1 - len(list_distinct(t)) / len(t)::double) end as reward from g""")
def repetition_penalty(spark, sf_dir):
    return _docs(spark, sf_dir, rewards.repetition(F.col("text")).alias("reward"))


@query("select doc_id, least(-(n_chars - 900) / 300.0::double, 0) as reward from documents")
def soft_overlong(spark, sf_dir):
    return _docs(spark, sf_dir, rewards.overlong(F.col("n_chars"), 1200, 300).alias("reward"))


@query("""select doc_id, case when quality = 1 then 1.0::double - (1.0 - 0.5) * (1 - cos(n_chars * pi() / 5000)) / 2 else -0.5::double - (-0.5 - 0.0) * (1 - cos(n_chars * pi() / 5000)) / 2 end as reward from documents join labels using (doc_id)""")
def cosine_reward(spark, sf_dir):
    d = _docs(spark, sf_dir, "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", rewards.cosine_length(F.col("n_chars"), F.col("quality") == 1, 5000).alias("reward"))


@query("select doc_id, case when doc_id % 3 = 0 then 1.0::double else 0.0::double end as format, case when doc_id % 3 = 1 then 1.0::double else 0.0::double end as react from documents")
def format_rewards(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n<answer>1</answer>"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> Action: a\nAction Input: {}"))).otherwise(F.concat(F.lit("x\n<think>a</think><answer>b</answer>")))
    return _docs(spark, sf_dir, rewards.think_answer(t).alias("format"), rewards.think_action(t).alias("react"))


@query("select doc_id, (doc_id % 11) / 10.0::double as judged, case when doc_id % 2 = 0 then (doc_id % 11) / 10.0::double else 0.0::double end as mean, (n_chars::double) as process from documents")
def judge_rewards(spark, sf_dir):
    one = F.concat(F.lit("It is fine. Reward: "), F.format_string("%.1f", (F.col("doc_id") % 11) / 10))
    many = F.when(F.col("doc_id") % 2 == 0, F.array(one, F.lit("none"))).otherwise(F.array(F.lit("nothing")))
    return _docs(spark, sf_dir, rewards.judged(one).alias("judged"), rewards.judged_mean(many).alias("mean"), rewards.process_score(F.format_string("x Reward: **%d** ", "n_chars")).alias("process"))


@query("select doc_id, '\\frac{' || lang || '}{2}' as boxed, 1.0::double as same from documents")
def boxed_answers(spark, sf_dir):
    t = F.format_string("so \\boxed{0} and then \\boxed{\\frac{%s}{2}} ok", "lang")
    b = rewards.boxed(t)
    return _docs(spark, sf_dir, b.alias("boxed"), rewards.same_answer(F.replace(b, F.lit("\\frac"), F.lit("$\\dfrac ")), b).alias("same"))


@query("""select doc_id, case when doc_id % 4 = 0 then 1.0::double else 0.0::double end as matched, case when doc_id % 4 = 0 then 1.0::double when doc_id % 4 = 1 then 0.75::double when doc_id % 4 = 2 then 2.0::double / 3 else 0.0::double end as score from documents""")
def tool_rewards(spark, sf_dir):
    want = F.lit('{"a": 1, "b": "x"}')
    got = F.when(F.col("doc_id") % 4 == 0, '{"b": "x", "a": 1}').when(F.col("doc_id") % 4 == 1, '{"b": "x", "a": 2}').when(F.col("doc_id") % 4 == 2, '{"a": 1}').otherwise("text")
    return _docs(spark, sf_dir, rewards.tool_match(F.lit("f"), got, F.lit("f"), want).alias("matched"), rewards.argument_score(got, want).alias("score"))


@query("select doc_id, case when n_chars * 100 > 90000 then floor(n_chars * sqrt(90000.0::double / (n_chars * 100)))::int else n_chars::int end as w, case when n_chars * 100 > 90000 then floor(100 * sqrt(90000.0::double / (n_chars * 100)))::int else 100 end as h from documents")
def resized_images(spark, sf_dir):
    """Images of n_chars by 100 scaled down to 90,000 pixels."""
    w, h = render.resized(F.col("n_chars"), F.lit(100), 90_000)
    return _docs(spark, sf_dir, w.alias("w"), h.alias("h"))
