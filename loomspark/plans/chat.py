"""Queries over conversations: normalising, filtering, rendering, masks, tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lossmask, render, rewards, tokens, tools
from ..operators import expand, filters, normalize, recipes
from .registry import query, table

#: Conversations in DuckDB.
CONV = "conv as (select conv_id, list({'role': role, 'content': text} order by turn) as m from conversations group by conv_id)"
REST = CONV + ", rest as (select conv_id, case when m[1].role = 'system' then m[1].content end as sys, case when m[1].role = 'system' then m[2:] else m end as r from conv)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id with its messages in turn order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    got = expand.gathered(rows, ["conv_id"], "turn", ["role", "content"], "m")
    return got.select("conv_id", F.transform("m", lambda x: normalize.message(x["role"], x["content"])).alias("messages"))


@query(f"with {CONV} select conv_id, len(m) as n_turns, md5(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|')) as digest from conv")
def conv_messages(spark, sf_dir):
    m = conversations(spark, sf_dir)
    return m.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("select conv_id from conversations group by conv_id having bool_and(text is not null and role in ('system','user','tool_call','tool_response','tool','assistant')) and count(*) > 1")
def conv_valid(spark, sf_dir):
    return filters.drop_bad(conversations(spark, sf_dir)).where(F.size("messages") > 1).select("conv_id")


RENDER = f"""with {REST},
pairs as (select conv_id, sys, case when len(r) % 2 = 1 then list_append(r, {{'role': 'assistant', 'content': null}}) else r end as p from rest),
t as (select conv_id, case when sys is not null and sys <> '' then '<|im_start|>system' || chr(10) || sys || '<|im_end|>' || chr(10) else '' end ||
  array_to_string(list_transform(range(1, len(p) // 2 + 1), lambda i: '<|im_start|>user' || chr(10) || p[2*i-1].content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ||
    case when i < len(p) // 2 or p[2*i].content is not null then p[2*i].content || '<|im_end|>' || chr(10) else '' end), '') as text from pairs)
"""


@query(RENDER + "select conv_id, md5(text) as digest, len(text)::bigint as n_chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from t")
def conv_render(spark, sf_dir):
    """Valid conversations as text of a chat template, with stand-in token counts."""
    t = filters.drop_bad(conversations(spark, sf_dir)).select("conv_id", render.rendered(F.col("messages")).alias("text"))
    return t.select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), F.size(tokens.words(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"with {CONV} select conv_id, coalesce(list_max(list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'user')), -1)::bigint as last_user from conv")
def conv_last_user(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", render.last_user(F.col("messages")).cast("long").alias("last_user"))


@query(f"with {CONV}, e as (select conv_id, m, coalesce(list_max(list_filter(range(1, len(m) + 1), lambda i: m[i].role <> 'assistant')), 0) as n from conv) select conv_id, n::bigint as n_turns, coalesce(m[n].content, '') as last_text from e")
def conv_strip_tail(spark, sf_dir):
    m = conversations(spark, sf_dir).select("conv_id", render.without_tail(F.col("messages")).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.coalesce(F.try_element_at("m", F.lit(-1))["content"], F.lit("")).alias("last_text"))


@query("""with flat as (select conv_id, turn, case when role = 'system' then 'user' else role end as role, text from conversations),
runs as (select *, sum(case when role = prev then 0 else 1 end) over (partition by conv_id order by turn) as run from (select *, lag(role) over (partition by conv_id order by turn) as prev from flat)),
g as (select conv_id, run, any_value(role) as role, string_agg(text, '' order by turn) as text from runs group by conv_id, run)
select conv_id, count(*) as n_turns, md5(string_agg(role || ':' || text, '|' order by run)) as digest from g group by conv_id""")
def conv_merge_same_role(spark, sf_dir):
    flat = conversations(spark, sf_dir).select("conv_id", F.transform("messages", lambda m: F.struct(F.when(m["role"] == "system", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content"))).alias("m"))
    got = flat.select("conv_id", render.merged_turns(F.col("m")).alias("m"))
    return got.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query(f"with {REST} select conv_id, len(r) // 2 + len(r) % 2 as n_rounds, md5(coalesce(array_to_string(list_transform(range(1, len(r) + 1, 2), lambda i: r[i].content || '>' || coalesce(r[i + 1].content, '-')), '|'), '')) as digest from rest")
def conv_history(spark, sf_dir):
    """Messages as [query, response] pairs."""
    h = conversations(spark, sf_dir).select("conv_id", normalize.messages_history(F.col("messages")).alias("h"))
    return h.select("conv_id", F.size("h").cast("long").alias("n_rounds"), F.md5(F.array_join(F.transform("h", lambda p: F.concat(p[0], F.lit(">"), F.coalesce(p[1], F.lit("-")))), "|")).alias("digest"))


@query(f"with {REST} select conv_id, md5(array_to_string(list_transform(case when sys is null then r else list_prepend({{'role': 'system', 'content': sys}}, r) end, lambda x: x.role || ':' || x.content), '|')) as digest from rest where len(r) >= 2")
def history_normalise(spark, sf_dir):
    """Rows of query, response, history and system become messages again."""
    c = conversations(spark, sf_dir)
    system, rest = render.system_of(F.col("messages"))
    rows = c.select("conv_id", system.alias("system_prompt"), normalize.messages_history(rest).alias("h")).where(F.size("h") > 0)
    rows = rows.select("conv_id", "system_prompt", F.element_at("h", -1)[0].alias("Question"), F.element_at("h", -1)[1].alias("answer"), F.slice("h", 1, F.size("h") - 1).alias("history"))
    got = normalize.normalize(rows, keep=("conv_id",)).where(F.size(F.filter("messages", lambda m: m["role"] != "system")) >= 2)
    return got.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("select doc_id, 'user' as first_role, md5(case when lang = 'en' then source || chr(10) || lang else source end) as query_digest, md5(text) as answer_digest from documents")
def alpaca_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.col("source").alias("instruction"), F.when(F.col("lang") == "en", F.col("lang")).otherwise("").alias("input"), F.col("text").alias("output"))
    got = normalize.normalize(rows, keep=("doc_id",))
    return got.select("doc_id", F.get("messages", 0)["role"].alias("first_role"), F.md5(F.get("messages", 0)["content"]).alias("query_digest"), F.md5(F.get("messages", 1)["content"]).alias("answer_digest"))


@query(f"with {REST} select conv_id, len(r)::bigint + (sys is not null)::bigint as n_turns, md5(array_to_string(list_transform(r, lambda x: x.role || ':' || x.content), '|')) as digest from rest where len(r) >= 2 and len(r) % 2 = 0")
def sharegpt_normalise(spark, sf_dir):
    """human/assistant pairs with a system column."""
    c = conversations(spark, sf_dir)
    system, rest = render.system_of(F.col("messages"))
    rows = c.select("conv_id", system.alias("system"), rest.alias("r")).where((F.size("r") >= 2) & (F.size("r") % 2 == 0))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("r") / 2).cast("int") - 1), lambda i: F.struct(F.get("r", i * 2)["content"].alias("human"), F.get("r", i * 2 + 1)["content"].alias("assistant")))
    got = normalize.normalize(rows.select("conv_id", "system", pairs.alias("conversation")), keep=("conv_id",))
    plain = F.filter("messages", lambda m: m["role"] != "system")
    return got.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform(plain, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query(f"with {CONV} select conv_id, len(m)::bigint as n_turns, md5(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|')) as digest from conv")
def from_value_normalise(spark, sf_dir):
    """from/value turns with human and gpt roles."""
    c = conversations(spark, sf_dir)
    turn = lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value"))
    got = normalize.normalize(c.select("conv_id", F.transform("messages", turn).alias("conversations")), keep=("conv_id",))
    return got.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("select doc_id, 1::bigint as n_turns, 'assistant' as role, md5(text) as digest, source as channel from documents where text is not null")
def response_normalise(spark, sf_dir):
    """Plain texts as pretraining rows: one assistant turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("channel"))
    got = normalize.normalize(d, keep=("doc_id",))
    return got.select("doc_id", F.size("messages").cast("long").alias("n_turns"), F.get("messages", 0)["role"].alias("role"), F.md5(F.get("messages", 0)["content"]).alias("digest"), "channel")


MASK = f"""with {REST}, pr as (select conv_id, coalesce(list_max(list_filter(range(0, len(r)), lambda i: r[i + 1].role = 'user')), -1) as lu, r from rest),
turns as (select conv_id, lu, unnest(range(0, len(r) // 2)) as i, r from pr),
n as (select conv_id, i, len(regexp_extract_all(r[2 * i + 2].content, '[^\\x20\\x09-\\x0D]+')) as w, 2 * i >= lu as late from turns)
"""


@query(MASK + "select conv_id, sum(w)::bigint as all_answers, coalesce(sum(case when late then w end), 0)::bigint as last_answers from n group by conv_id")
def conv_loss_tokens(spark, sf_dir):
    """Answer words that count in the loss under the default and the last-round strategy."""
    c = conversations(spark, sf_dir)
    system, rest = render.system_of(F.col("messages"))
    c = c.select("conv_id", system.alias("system"), rest.alias("r")).where(F.size("r") >= 2)
    c = c.withColumn("lu", render.last_user(F.col("r"))).withColumn("p", render.parts(render.standardised(F.col("r")), F.col("system"), render.CHATML))
    p = c.select("conv_id", "lu", F.explode("p").alias("p")).select("conv_id", "lu", "p.*").where("kind = 'response'")
    n = F.size(tokens.words(F.col("text")))
    late = lossmask.base_scale(F.col("kind"), F.col("round") * 2, F.lit(None).cast("double"), F.col("lu"), "last_round")
    every = lossmask.base_scale(F.col("kind"), F.col("round") * 2, F.lit(None).cast("double"), F.col("lu"), "default")
    return p.groupBy("conv_id").agg(F.sum(n * every).cast("long").alias("all_answers"), F.sum(n * late).cast("long").alias("last_answers"))


@query(f"with {CONV} select conv_id, md5(array_to_string(list_transform(m, lambda x: upper(x.role[1]) || x.role[2:] || ': ' || x.content), chr(10))) as digest from conv")
def conv_transcript(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.md5(rewards.transcript(F.col("messages"))).alias("digest"))


@query(f"with {REST}, lu as (select conv_id, r, list_max(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'user')) as n from rest) select conv_id, n::bigint + 1 as n_turns, md5('rejected ' || conv_id) as last_digest from lu where n is not null")
def rejected_messages(spark, sf_dir):
    """A rejected response becomes rejected messages: the conversation to its last query, and the response."""
    c = conversations(spark, sf_dir)
    _, rest = render.system_of(F.col("messages"))
    got = c.select("conv_id", normalize.rejected_from_response(rest, F.concat(F.lit("rejected "), F.col("conv_id").cast("string"))).alias("m")).where("m is not null")
    return got.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.md5(F.element_at("m", -1)["content"]).alias("last_digest"))


@query(f"""with {REST}, x as (select conv_id, r, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'user')), 0) as lu from rest)
select conv_id, sum(len(case when role = 'assistant' and i < lu then content else pre || content end))::bigint as n_chars from
(select conv_id, lu, i, r[i].role as role, r[i].content as content, case when r[i].role = 'assistant' then '<think>x</think>' || chr(10) else '' end as pre from (select *, unnest(range(1, len(r) + 1)) as i from x)) group by conv_id""")
def conv_strip_thinking(spark, sf_dir):
    """Answers before the last query lose their thinking."""
    c = conversations(spark, sf_dir)
    _, rest = render.system_of(F.col("messages"))
    thought = F.transform(rest, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", F.concat(F.lit("<think>x</think>\n"), m["content"])).otherwise(m["content"]).alias("content")))
    got = c.select("conv_id", thought.alias("t")).select("conv_id", render.without_old_thinking(F.col("t")).alias("t"))
    # texts end with a full stop, so trimming only takes the line feed after the mark
    return got.select("conv_id", F.aggregate("t", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("n_chars"))


# -- tool calls and weights ------------------------------------------------------------------


def _calls(d: DataFrame, kind: str, text) -> DataFrame:
    got = d.select("doc_id", F.explode(tools.tool_calls(text, kind)).alias("c"))
    return got.select("doc_id", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


@query("""select doc_id, lang as name, '{"n":' || n_chars || ',"s":"' || source || '"}' as arguments from documents union all select doc_id, source, '{"a":1}' from documents""")
def tool_calls_hermes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.format_string('x <tool_call>\n{"name": "%s", "arguments": {"n":%d,"s":"%s"}}\n</tool_call> y\n<tool_call>{"name": "%s", "arguments": {"a":1}}</tool_call><tool_call>no json</tool_call>', "lang", "n_chars", "source", "source")
    return _calls(d, "hermes", text)


@query("""select doc_id, ' ' || lang || chr(10) as name, ' ' || n_chars || chr(10) as arguments from documents union all select doc_id, ' ' || source || chr(10), ' {}' from documents""")
def tool_calls_react(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.format_string("Thought: t\nAction: %s\nAction Input: %d\nObservation: o\nAction: %s\nAction Input: {}", "lang", "n_chars", "source")
    return _calls(d, "react", text)


@query("""select doc_id, lang as name, '{"k":"' || source || '","m":"2"}' as arguments from documents""")
def tool_calls_tagged(spark, sf_dir):
    """Calls with tagged parameters, in three formats that agree."""
    d = table(spark, sf_dir, "documents")
    a = _calls(d, "qwen_coder", F.format_string("<tool_call>\n<function=%s>\n<parameter=k>\n%s\n</parameter>\n<parameter=m> 2 </parameter>\n</function>\n</tool_call>", "lang", "source"))
    b = _calls(d, "seed", F.format_string("<seed:tool_call><function=%s><parameter=k>%s</parameter><parameter=m>2</parameter></function></seed:tool_call>", "lang", "source"))
    c = _calls(d, "glm45", F.format_string("<tool_call>%s\n<arg_key>k</arg_key><arg_value>%s</arg_value><arg_key>m</arg_key>\n<arg_value>2</arg_value></tool_call>", "lang", "source"))
    return a.intersect(b).intersect(c)


@query("""select doc_id, lang as name, '{"n":' || n_chars || '}' as arguments from documents""")
def tool_calls_json(spark, sf_dir):
    """Calls as bare JSON, in four formats that agree."""
    d = table(spark, sf_dir, "documents")
    out = _calls(d, "llama", F.format_string('{"name": "%s", "parameters": {"n":%d}}<|eom_id|>', "lang", "n_chars"))
    for kind, text in (("mistral", '[TOOL_CALLS][{"name": "%s", "arguments": {"n":%d}}]</s>'), ("glm4", '%s\n{"n":%d}\n'), ("deepseek", "<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>%s<｜tool▁sep｜>{\"n\":%d}<｜tool▁call▁end｜>")):
        out = out.intersect(_calls(d, kind, F.format_string(text, "lang", "n_chars")))
    return out


@query("""select doc_id, 2.0::double * (len('Action:') + len(' ' || lang || chr(10))) + 2.0::double * (len('Action Input:') + len(' ' || n_chars || chr(10))) + 2.0::double * len('Observation:') + len('Thought:' || ' t' || chr(10)) as weighted, 8::bigint as parts from documents""")
def loss_weights_react(spark, sf_dir):
    """Weighted characters of an Action text: observations count 0, their mark 2."""
    d = table(spark, sf_dir, "documents")
    text = F.format_string("Thought: t\nAction: %s\nAction Input: %d\nObservation: o", "lang", "n_chars")
    got = d.select("doc_id", lossmask.weighted(text, "react").alias("w"))
    return got.select("doc_id", F.aggregate("w", F.lit(0.0), lambda a, x: a + F.length(x["text"]) * x["weight"]).alias("weighted"), F.size("w").cast("long").alias("parts"))


@query("""select doc_id, (len('a ') + 2 * len('<tool_call>' || lang || '</tool_call>') + len(' b'))::double as weighted, 3::bigint as parts from documents""")
def loss_weights_hermes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    got = d.select("doc_id", lossmask.merged_weights(lossmask.weighted(F.format_string("a <tool_call>%s</tool_call> b", "lang"), "hermes")).alias("w"))
    return got.select("doc_id", F.aggregate("w", F.lit(0.0), lambda a, x: a + F.length(x["text"]) * x["weight"]).alias("weighted"), F.size("w").cast("long").alias("parts"))


@query("select doc_id, 'Here gives some useful information:' || chr(10) || lang || chr(10) || source as query, md5(text) as answer from documents where lang <> 'en' union all select doc_id, source, md5(text) from documents where lang = 'en'")
def recipe_context_question(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("context"), F.col("text").alias("response"))
    got = recipes.context_question(d)
    return got.select("doc_id", F.get("messages", 0)["content"].alias("query"), F.md5(F.get("messages", 1)["content"]).alias("answer"))


@query(f"with {REST} select conv_id, (len(r) // 2 * 2)::bigint as n_turns, md5(array_to_string(list_transform(r[1 : len(r) // 2 * 2], lambda x: x.role || ':' || x.content), '|')) as digest from rest where len(r) >= 2")
def recipe_dialogues(spark, sf_dir):
    """Human / Assistant text split into turns again."""
    c = conversations(spark, sf_dir)
    _, rest = render.system_of(F.col("messages"))
    text = F.array_join(F.transform(rest, lambda m: F.concat(F.when(m["role"] == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), m["content"])), "")
    got = c.select("conv_id", recipes.dialogue(text).alias("m")).where(F.size("m") >= 2)
    return got.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest"))


@query("select doc_id, case when n_chars % 2 = 0 then 'b' else 'a' end || '-' || (n_chars % 2) as label_name, lang || ' ' || source as filled from documents")
def recipe_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("label", (F.col("n_chars") % 2).cast("string"))
    d = normalize.to_class(d)
    prompt, name = normalize.class_prompt("t", ["b-0", "a-1"], [F.col("lang")], F.col("label"))
    return d.select("doc_id", name.alias("label_name"), normalize.generation_prompt(F.col("lang"), "{{QUERY}} ").alias("q"), "source").select("doc_id", "label_name", F.concat("q", "source").alias("filled"))


@query("select doc_id, least(a, c) as x1, greatest(a, c) as x2, round_even(least(a, c) / 500.0 * 1000, 0)::int as sx from (select doc_id, (n_chars % 500)::double as a, (n_chars % 77)::double as c from documents)")
def boxes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.array((F.col("n_chars") % 500).cast("double"), F.lit(9.0), (F.col("n_chars") % 77).cast("double"), F.lit(3.0))).alias("b"))
    got = d.select("doc_id", F.get(normalize.bbox(F.col("b")), 0).alias("b"))
    return got.select("doc_id", F.get("b", 0).alias("x1"), F.get("b", 2).alias("x2"), F.get(render.scaled_box(F.col("b"), F.lit(500.0), F.lit(500.0)), 0).alias("sx"))


@query("select doc_id, repeat('<image>', 2) || source as tagged, 'a<image>b' as text, lang as path, case when lang = 'en' then 'image' when lang = 'fr' then 'audio' end as kind from documents")
def media_tags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text, paths = render.inline_images(F.format_string("a<img>%s</img>b", "lang"))
    ext = F.concat(F.lit("x."), F.when(F.col("lang") == "en", "JPG").when(F.col("lang") == "fr", "wav").otherwise("bin"))
    return d.select("doc_id", render.with_media_tags(F.col("source"), "<image>", F.lit(2)).alias("tagged"), text.alias("text"), F.get(paths, 0).alias("path"), render.media_kind(ext).alias("kind"))


@query(f"""with {REST}, pairs as (select conv_id, sys, r, len(r) // 2 as k from rest), a as (select conv_id, coalesce(sum(len(regexp_extract_all(r[2 * i].content, '[^\\x20\\x09-\\x0D]+'))), 0) as w from (select *, unnest(range(1, k + 1)) as i from pairs) group by conv_id)
select p.conv_id, coalesce(a.w, 0)::bigint + (len(r) % 2 = 0 and len(r) > 0)::bigint as open_labels from pairs p left join a on p.conv_id = a.conv_id""")
def encode_causal(spark, sf_dir):
    """Encoded conversations: as many open labels as answers have words, and the end mark of the last one."""
    from ..functions import encode

    c = conversations(spark, sf_dir)
    got = encode.task_rows(c, "causal_lm")
    return got.select("conv_id", F.size(F.filter("labels", lambda x: x != tokens.MASKED)).cast("long").alias("open_labels"))


@query(f"""with {REST} select conv_id, 2::bigint as sides, true as same_prompt from rest where len(r) >= 2 and len(r) % 2 = 0""")
def encode_preference(spark, sf_dir):
    """Chosen and rejected sides share everything but the last answer, and are padded to one length."""
    from ..functions import encode

    c = conversations(spark, sf_dir)
    _, rest = render.system_of(F.col("messages"))
    c = c.select("conv_id", rest.alias("messages")).where((F.size("messages") >= 2) & (F.size("messages") % 2 == 0))
    c = c.withColumn("rejected_messages", normalize.rejected_from_response(F.col("messages"), F.lit("no")))
    got = encode.task_rows(c, "rlhf").withColumn("batch", F.col("conv_id"))
    sides = encode.stacked(got, "batch", "conv_id")
    n = F.size("input_ids")
    head = F.md5(F.slice("input_ids", 1, 3).cast("string"))
    return sides.groupBy("conv_id").agg(F.count("*").alias("sides"), ((F.min(n) == F.max(n)) & (F.min(head) == F.max(head))).alias("same_prompt"))


@query("select doc_id, least(a, 64)::bigint as n from (select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as a from documents) where a > 0 and a <= 64 union all select doc_id, 64 from (select doc_id, unnest(range(a // 64)) as i from (select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as a from documents) where a > 64) union all select doc_id, (a % 64)::bigint from (select doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as a from documents) where a > 64 and a % 64 > 0")
def encode_split(spark, sf_dir):
    """Long samples become several rows of at most 64 tokens."""
    from ..functions import encode

    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"))
    got = encode.task_rows(d, "causal_lm", template=render.PLAIN).where(F.size("input_ids") > 0)
    return encode.fitted(got, 64, "split").select("doc_id", F.col("length").cast("long").alias("n"))
