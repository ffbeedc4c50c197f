"""Queries over single steps: columns, filters, template and token details, user code, streams."""

from __future__ import annotations

import asyncio
import tempfile

from pyspark.sql import functions as F

from ..functions import encode, extend, jsonfix, lossmask, metrics, prompts, render, rewards, tokens, tools
from ..operators import advantage, combine, expand, filters, normalize, packing, sampling
from ..sources.scratch import folder
from ..streaming import streams
from .chat import CONV, REST, conversations
from .data import IDS, WORDS, _ids
from .registry import query, table
from .sets import DOCS, EVEN, H, ID, LANG, NL, SRC, digest, docs, shown, words
from .streams import _stream

#: Shards of the streams with state.
SHARDS = 16
#: Tokens of one bin in the packing queries.
PACK = 4096
IDS_OF = f"t as (select doc_id, {IDS} as ids from documents)"


def total(ids):
    return F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)


# -- columns -----------------------------------------------------------------------------------


@query(f"with {DOCS} select doc_id, source as q, lang as ask, h as \"Other\" from d")
def renamed_columns(spark, sf_dir):
    """Renamed without case; where two columns would take one name, neither does."""
    d = docs(spark, sf_dir).select("doc_id", SRC().alias("QUERY"), LANG().alias("ask"), H().alias("Other"))
    return normalize.safe_rename(d, {"query": "q", "ask": "same", "other": "same"})


@query(f"with {DOCS} select doc_id, source as channel, lang as kept from d")
def pruned_columns(spark, sf_dir):
    """Standard columns and those asked for; protected names come back."""
    d = docs(spark, sf_dir).select("doc_id", SRC().alias("__@channel"), LANG().alias("__#kept"), H().alias("gone"))
    return normalize.prune(normalize.strip_prefix(d), ("doc_id", "kept"))


@query(f"with {DOCS} select doc_id, md5('user:' || source || '|assistant:' || h) as digest, lang as image, 1 as n_images, source as video, case when doc_id % 2 = 0 then 1.0::double end as label from d")
def media_columns(spark, sf_dir):
    """image and videos of a row as lists, labels in their fixed type."""
    d = docs(spark, sf_dir).select("doc_id", SRC().alias("query"), H().alias("response"), LANG().alias("image"), SRC().alias("videos"), F.when(EVEN(), F.lit("1")).alias("label"))
    got = normalize.normalize(d, keep=("doc_id",))
    return digest(got, F.get("images", 0)["path"].alias("image"), F.size("images").alias("n_images"), F.get("videos", 0).alias("video"), F.col("label").cast("double").alias("label"))


@query(f"with {DOCS} select doc_id, md5(case when doc_id % 3 < 2 then 'user:' || source || '|assistant:' || lang || '|' else '' end || 'user:q|assistant:' || h) as digest from d")
def literal_history(spark, sf_dir):
    """Histories as Python literals and as JSON; what neither reads is none."""
    past = F.when(ID() % 3 == 0, words("[['", SRC(), "', '", LANG(), "']]")).when(ID() % 3 == 1, words('[["', SRC(), '", "', LANG(), '"]]')).otherwise("oops[")
    return digest(normalize.from_response(docs(spark, sf_dir).select("doc_id", F.lit("q").alias("query"), H().alias("response"), past.alias("history"))))


@query("select doc_id, doc_id::int as label from documents where doc_id % 2 = 0")
def class_labels(spark, sf_dir):
    """Integer labels; others go."""
    return normalize.to_class(docs(spark, sf_dir).select("doc_id", F.when(EVEN(), ID().cast("string")).otherwise("x").alias("label")))


@query(f"with {DOCS}, x as (select *, ('0x' || md5('language:' || doc_id)[1:8])::bigint / 4294967296.0::double < 0.8 as en from d) select doc_id, 'Q: ' || source || '!' as prompt, case when en then 'Find it' else '找' end as find, source || '<image>' || lang as text, 'u' || lang as url from x")
def prompts_and_parts(spark, sf_dir):
    """A filled prompt, a grounding prompt by hash, and content parts as text with tags."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))
    none = F.lit(None)
    d = docs(spark, sf_dir, parts=F.array(part("text", SRC(), none), part("image_url", none, words("u", LANG())), part("text", LANG(), none)))
    text, urls = normalize.parts_text(F.col("parts"))
    ground = normalize.grounding_prompt("grounding", {"grounding": {"en": ["Find it"], "zh": ["找"]}}, "doc_id")
    return d.select("doc_id", normalize.generation_prompt(SRC(), "Q: {{QUERY}}!").alias("prompt"), ground.alias("find"), text.alias("text"), F.get(urls, 0).alias("url"))


@query(f"with {DOCS} select doc_id, md5('user:' || source || '|assistant:' || h) as chosen, md5('user:' || source || '|assistant:' || lang) as rejected, lang as image from d where doc_id % 2 = 0")
def preference_bundles(spark, sf_dir):
    """Rejected answers that equal the chosen one go; the rejected side takes images from the chosen one."""
    d = docs(spark, sf_dir).select("doc_id", SRC().alias("query"), H().alias("response"), F.when(EVEN(), LANG()).otherwise(H()).alias("rejected_response"), F.array("lang").alias("images"))
    got = normalize.normalize(d, keep=("doc_id",))
    got = normalize.preference_bundle(got.withColumn("rejected_messages", normalize.rejected_from_response(F.col("messages"), F.col("rejected_response"))))
    return got.select("doc_id", F.md5(shown(F.col("chosen.messages"))).alias("chosen"), F.md5(shown(F.col("rejected.messages"))).alias("rejected"), F.get("rejected.images", 0)["path"].alias("image"))


# -- rows --------------------------------------------------------------------------------------


@query("select doc_id, lang from documents where lang in ('en', 'fr') and (lang = 'en' or source <> 'src1')")
def rows_with_files(spark, sf_dir):
    """Rows whose file is listed, rows of which all files are listed, rows with known tags only."""
    d = docs(spark, sf_dir, path=words(LANG(), ".jpg"), both=F.array(words(LANG(), ".jpg"), words(LANG(), "-", SRC())))
    files = docs(spark, sf_dir).select(words(LANG(), ".jpg").alias("path")).unionByName(docs(spark, sf_dir).where("lang = 'en' or source <> 'src1'").select(words(LANG(), "-", SRC()).alias("path")))
    got = filters.all_existing(filters.existing(d, "path", files), "both", "doc_id", files)
    return got.where(filters.alias_present(F.array("lang"), ["en", "fr"])).select("doc_id", "lang")


@query("""with g as (select doc_id, source, row_number() over (order by md5('redraw:' || doc_id), doc_id) as r from documents where doc_id % 2 = 0), bad as (select count(*) as n from documents where doc_id % 2 = 1)
select doc_id, count(*) as times from (select doc_id from g union all select doc_id from g, bad where r <= n) group by doc_id""")
def redrawn_rows(spark, sf_dir):
    """Bad rows are replaced by good ones in hash order, and a strict check passes them all."""
    d = docs(spark, sf_dir).select("doc_id", F.when(EVEN(), normalize.message("user", SRC())).alias("m")).select("doc_id", F.array("m").alias("messages"))
    got = filters.drop_bad(filters.redraw(d, filters.valid_messages(F.col("messages")), "doc_id"), strict=True)
    return got.groupBy("doc_id").agg(F.count("*").alias("times"))


@query(f"with {DOCS} select doc_id, source, lang as word, 0 as i from d union all select doc_id, source, h, 1 from d")
def fanned_rows(spark, sf_dir):
    """Several rows of one."""
    one = lambda c, i: F.struct(c.alias("word"), F.lit(i).alias("i"))
    return expand.fan_out(docs(spark, sf_dir), F.array(one(LANG(), 0), one(H(), 1))).select("doc_id", "source", "word", "i")


@query("select doc_id, epoch from (select doc_id from documents order by md5('shuffle:' || doc_id), doc_id limit 10), (select unnest([0, 1]) as epoch)")
def shuffled_epochs(spark, sf_dir):
    """The first ten rows of a shuffled order, in each of two epochs."""
    first = sampling.shuffled(docs(spark, sf_dir).select("doc_id"), "doc_id").limit(10)
    return sampling.epochs(first, 2).select("doc_id", "epoch")


@query("with g as (select doc_id, 0 as f from documents where doc_id % 2 = 0 and lang = 'en' union all select doc_id, 1 from documents where lang = 'en') select doc_id, count(*) as times from (select doc_id from g order by f, md5('backup:' || doc_id), doc_id limit (select count(*) from documents where lang = 'en')) group by doc_id")
def topped_up_rows(spark, sf_dir):
    """Good rows first, then good backup rows, as many as are asked for."""
    d = docs(spark, sf_dir).select("doc_id", "lang")
    n = d.where("lang = 'en'").count()
    return sampling.topped_up(d.where("doc_id % 2 = 0"), d, F.col("lang") == "en", "doc_id", n).groupBy("doc_id").agg(F.count("*").alias("times"))


@query("select lang, count(*) over () as kinds, 2 * n as rows from (select lang, count(*) as n from documents group by lang)")
def concatenated_rows(spark, sf_dir):
    """Two frames with unequal columns in one; distinct values of a column."""
    d = docs(spark, sf_dir)
    both = combine.concat([d.select("doc_id", "lang"), d.select("lang", "source")])
    kinds = combine.distinct_by(d.select("lang"), "lang")
    return both.groupBy("lang").agg(F.count("*").alias("rows")).join(kinds, "lang").crossJoin(kinds.agg(F.count("*").alias("kinds")))


@query("select user_id, event_id, value, truth from (select user_id, event_id, value, false as truth from events union all select user_id, -1, max(value), true from events group by user_id)")
def candidates_with_truth(spark, sf_dir):
    """Ground truth as one more candidate of each group."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lit(False).alias("truth"))
    truth = e.groupBy("user_id").agg(F.max("value").alias("value")).select("user_id", F.lit(-1).cast("long").alias("event_id"), "value", F.lit(True).alias("truth"))
    return advantage.with_truth(e, truth)


# -- template ----------------------------------------------------------------------------------


@query(f"with {REST}, p as (select conv_id, sys, case when len(r) % 2 = 1 then list_append(r, {{'role': 'assistant', 'content': null}}) else r end as p from rest) select conv_id, len(p)::bigint as n_pairs2, md5(array_to_string(list_transform(p, lambda x: x.role || ':' || coalesce(x.content, '~')), '|')) as digest, md5(coalesce(sys, '') || array_to_string(list_transform(p, lambda x: coalesce(x.content, '')), '')) as plain from p")
def conv_plain(spark, sf_dir):
    """Standardised pairs, and the bare text of the plain template."""
    c = conversations(spark, sf_dir)
    system, rest = render.system_of(F.col("messages"))
    p = c.select("conv_id", "messages", render.standardised(rest).alias("p"))
    return p.select("conv_id", F.size("p").cast("long").alias("n_pairs2"), F.md5(shown(F.col("p"))).alias("digest"), F.md5(render.rendered(F.col("messages"), render.PLAIN)).alias("plain"))


@query(f"""with {CONV}, u as (select conv_id, m, coalesce(list_max(list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'user')), -1) as l from conv)
select conv_id, md5(array_to_string(list_transform(range(1, len(m) + 1), lambda i: m[i].role || ':' || case when m[i].role = 'assistant' and i - 1 > l then '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} else '' end || m[i].content), '|')) as digest from u""")
def conv_empty_thinking(spark, sf_dir):
    """Answers after the last question start with empty thoughts."""
    return conversations(spark, sf_dir).select("conv_id", F.md5(shown(render.with_empty_thinking(F.col("messages")))).alias("digest"))


@query(f"with {DOCS} select doc_id, md5('user:' || source || '|assistant:' || lang || chr(10) || h || '|tool:' || source) as digest from d")
def merged_tool_calls(spark, sf_dir):
    """Neighbouring tool calls are one answer, tool responses are tool turns."""
    turns = F.array(*[normalize.message(r, c) for r, c in (("user", SRC()), ("tool_call", LANG()), ("tool_call", H()), ("tool_response", SRC()))])
    m = docs(spark, sf_dir).select("doc_id", F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("m"))
    return digest(m.select("doc_id", render.merged_calls(F.col("m")).alias("messages")))


@query(f"with {DOCS} select doc_id, 'a <image> b <image>' as text, source || ',' || lang as paths, h || ' and ' || source || ' and <box>' as filled, case doc_id % 3 when 0 then 'image' when 1 then 'audio' end as media, case doc_id % 4 when 0 then 'url' when 1 then 'data' when 2 then 'base64' else 'path' end as kind from d")
def media_texts(spark, sf_dir):
    """Inline images, numbered tags, kinds of media and of sources."""
    text, paths = render.inline_images(words("a <img>", SRC(), "</img> b <img>", LANG(), "</img>"))
    name = F.when(ID() % 3 == 0, words(H(), ".JPG")).when(ID() % 3 == 1, words(H(), ".wav")).otherwise(words(H(), ".xyz"))
    src = F.when(ID() % 4 == 0, words("https://", H())).when(ID() % 4 == 1, words("data:", H())).when(ID() % 4 == 2, F.repeat(H(), 7)).otherwise(H())
    return docs(spark, sf_dir).select("doc_id", text.alias("text"), F.array_join(paths, ",").alias("paths"), render.filled_tags(F.lit("<box> and <box> and <box>"), "<box>", F.array("h", "source")).alias("filled"), render.media_kind(name).alias("media"), render.source_kind(src).alias("kind"))


@query(f"""with {IDS_OF} select doc_id, (list_sum(list_transform(ids, lambda x: case when x % 2 = 0 then 11 + 12 + 13 else x end)))::bigint as total, len(list_filter(ids, lambda x: x % 2 = 0))::bigint as n_even,
coalesce(list_sum(list_filter(range(0, len(ids)), lambda i: ids[i + 1] % 2 = 0)), 0)::bigint as places, len(ids) as n, case when len(ids) > 0 then 1 else 0 end + 2 as found from t where len(ids) > 0""")
def token_edits(spark, sf_dir):
    """Placeholders filled, separators found, a trailing stop sequence removed, a sequence found."""
    d = _ids(spark, sf_dir).where(F.size("ids") > 0)
    zeros = F.transform("ids", lambda t: F.when(t % 2 == 0, F.lit(0)).otherwise(t))
    stop = tokens.without_stop(F.concat("ids", F.array(F.lit(-7), F.lit(-8))), [-7, -8])
    seen = tokens.find_all(F.concat(F.array(F.lit(-7), F.lit(-8)), "ids", F.array(F.lit(-7), F.lit(-8), F.lit(-7), F.lit(-8))), [-7, -8])
    return d.select("doc_id", total(tokens.expanded(zeros, 0, [11, 12, 13])).alias("total"), F.size(tokens.split_on(zeros, 0)).cast("long").alias("n_even"), total(tokens.split_on(zeros, 0)).alias("places"), F.size(stop).cast("long").alias("n"), F.size(seen).alias("found"))


@query("select doc_id, 4 as open, '0,0,1,0,1,1' as mask, '9,9,1,9,2,3' as flat, (doc_id % 2)::int as a, 1 as b from documents")
def token_shapes(spark, sf_dir):
    """A suffix after open labels is opened, flat values become padded rows, labels one-hot."""
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    opened = tokens.open_suffix(ints(-100, 5, 6, -100, -100, -100), ints(4, 5, 6, 7, 8, 9), [7, 8])
    rows, mask = tokens.unpacked(ints(1, 2, 3), ints(1, 2), 3, F.lit(9))
    hot = tokens.one_hot(F.array((ID() % 2).cast("int") * 0 + 1, F.when(ID() % 2 == 1, 0).otherwise(1)), 2)
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(opened, lambda x: x != -100)).alias("open"), F.array_join(F.flatten(mask), ",").alias("mask"), F.array_join(F.flatten(rows), ",").alias("flat"), F.get(hot, 0).alias("a"), F.get(hot, 1).alias("b"))


@query(f"with {DOCS} select doc_id, lang as field, 'none' as missing, '-|5,6|-|7' as ids, h as messages from d")
def answers_by_tokens(spark, sf_dir):
    """Token ids matched to answers from the last turn back; JSON fields with defaults; one side under plain names."""
    turns = F.array(*[F.struct(F.lit(r).alias("role"), SRC().alias("content")) for r in ("user", "assistant", "user", "assistant")])
    d = docs(spark, sf_dir, m=turns, given=F.array(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7))), js=words('{"a":"', LANG(), '"}'))
    got = encode.with_token_answers(F.col("m"), F.col("given"))
    side = encode.with_prefix(d.select("doc_id", H().alias("chosen_messages"), ID().alias("chosen_doc_id")), "chosen_")
    out = d.select("doc_id", encode.json_or(F.col("js"), "a", F.lit("none")).alias("field"), encode.json_or(F.col("js"), "b", F.lit("none")).alias("missing"), F.array_join(F.transform(got, lambda x: F.coalesce(F.array_join(x["ids"], ","), F.lit("-"))), "|").alias("ids"))
    return out.join(side, "doc_id")


# -- weights, tools ----------------------------------------------------------------------------


@query("select doc_id, 'last_round' as strategy, 'hermes' as map, true as even, false as odd, case when doc_id % 2 = 0 then 3.0::double else 1.0::double end as weight, 2 as n from documents")
def loss_specs(spark, sf_dir):
    """Names of weights, maps of zeros and ones only, weights by query, neighbours of equal weight as one."""
    strategy, name = lossmask.parse_spec("last_round+hermes")
    ask = F.when(EVEN(), "What is the value of x").otherwise("Hello")
    w = lossmask.weighted(F.lit("plain text"), "agentflan", ask)
    part = lambda t, x: F.struct(F.lit(t).alias("text"), F.lit(x).alias("weight"))
    merged = lossmask.merged_weights(F.array(part("a", 1.0), part("b", 1.0), part("c", 2.0)))
    return docs(spark, sf_dir).select("doc_id", F.lit(strategy).alias("strategy"), F.lit(name).alias("map"), F.lit(lossmask.is_binary("ignore_empty_think")).alias("even"), F.lit(lossmask.is_binary("react")).alias("odd"), F.get(w, 0)["weight"].alias("weight"), F.size(merged).alias("n"))


@query(f"""with {DOCS}, x as (select *, '{{"name":"' || lang || '","description":"' || source || '"}}' as t from d) select doc_id, 'Action: ' || lang || {NL} || 'Action Input: {{}}' || {NL} || 'Observation:' as react, '✿FUNCTION✿: ' || lang || {NL} || '✿ARGS✿: {{}}' || {NL} || '✿RESULT✿:' as qwen,
'<tool_response>' || {NL} || h || {NL} || '</tool_response>' as reply, '{{"type": "function", "function": ' || t || '}}' as wrapped, lang || ': ' || source as described,
'<tool_call>' || {NL} || '<function=' || lang || '>' || {NL} || '<parameter=a>' || {NL} || h || {NL} || '</parameter>' || {NL} || '</function>' || {NL} || '</tool_call>' as coder from x""")
def tool_texts(spark, sf_dir):
    """Calls, replies and descriptions as text, by format."""
    tool = words('{"name":"', LANG(), '","description":"', SRC(), '"}')
    one, none = F.array("lang"), F.array(F.lit("{}"))
    return docs(spark, sf_dir).select(
        "doc_id", tools.react_calls(one, none).alias("react"), tools.qwen_calls(one, none).alias("qwen"), tools.hermes_replies(F.array("h")).alias("reply"), tools.wrapped_tool(tool).alias("wrapped"),
        tools.described_tool(tools.wrapped_tool(tool)).alias("described"), tools.coder_calls(one, F.array(words('{"a":"', H(), '"}'))).alias("coder"),
    )


@query(f"with {DOCS} select doc_id, 1 as n, lang as name, '{{\"x\":1}}' as arguments, 1 as n_seed, source as seed_name, 1 as n_bench from d")
def tool_calls_more(spark, sf_dir):
    """Calls between begin and end marks, in seed tags, and in the keyword form."""
    deep = tools.deepseek(words("x<｜tool▁call▁begin｜>", LANG(), '<｜tool▁sep｜>{"x":1}<｜tool▁call▁end｜>'))
    seed = tools.seed(words("<seed:tool_call><function=", SRC(), "><parameter=a>1</parameter></function></seed:tool_call>"))
    bench = tools.toolbench(words("Action: ", LANG(), "\nAction Input: {}"))
    d = docs(spark, sf_dir).select("doc_id", deep.alias("a"), seed.alias("b"), bench.alias("c"))
    return d.select("doc_id", F.size("a").alias("n"), F.get("a", 0)["name"].alias("name"), F.get("a", 0)["arguments"].alias("arguments"), F.size("b").alias("n_seed"), F.get("b", 0)["name"].alias("seed_name"), F.size("c").alias("n_bench"))


@query(f"with {DOCS} select doc_id, true as react, true as qwen, true as hermes, '<think>' || lang || '</think>' || {NL} || {NL} || h as thought from d")
def tool_prompts(spark, sf_dir):
    """System prompts name every tool; a choice with its thinking."""
    tool = words('{"name":"', LANG(), '","description":"', SRC(), '","parameters":{"a":1}}')
    has = lambda text, *parts: F.contains(text, words(*parts))
    react, qwen, hermes = prompts.react_prompt(F.array(tool)), prompts.qwen_prompt(F.array(tool), H(), True), prompts.hermes_prompt(F.array(tool), H())
    return docs(spark, sf_dir).select(
        "doc_id", (has(react, LANG(), " API useful for? ", SRC()) & has(react, "should be one of [", LANG(), "]")).alias("react"), (qwen.startswith(H()) & has(qwen, "### ", LANG(), "\n\n", LANG(), ": ", SRC(), " Parameters: ", '{"a": 1}') & (F.regexp_count(qwen, F.lit("✿ARGS✿")) == 3)).alias("qwen"),
        (hermes.startswith(H()) & has(hermes, "<tools>\n", prompts.wrapped_tool(tool), "\n</tools>")).alias("hermes"), rewards.thought_choice(LANG(), H()).alias("thought"),
    )


def _sql_prompt(text: str, tools_: str, system: str = "''") -> str:
    """Digest of a fixed prompt text in SQL, with its places filled in."""
    return f"md5(replace(replace(replace('{text.replace("'", "''")}', '{{system}}', {system}), '{{names}}', a || ',' || b), '{{tools}}', {tools_}))"


def _sql_tools(form: str) -> str:
    one = lambda name, human, about, parameters: f"replace(replace(replace(replace('{form}', '{{name}}', {name}), '{{human}}', {human}), '{{about}}', {about}), '{{parameters}}', {parameters})"
    return f"{one('a', 'a', 's', 'p')} || {NL} || {NL} || {one('b', 'h', 's', QUOTED_EMPTY)}"


QUOTED_EMPTY = "'{}'"
TWO = """w as (select '{"type": "function", "function": ' || j || '}' as x, '{"type": "function", "function": ' || k || '}' as y, * from t)"""


@query(f"""with {DOCS}, s as (select doc_id, h, source as s, 'f_' || lang as a, 'g_' || source as b, '{{"type": "object", "properties": {{"a,b": ["c:d", 1], "e": ' || '"' || h || '"' || '}}}}' as p from d),
t as (select *, '{{"name": "' || a || '", "description": "' || s || '", "parameters": ' || p || '}}' as j, '{{"name": "' || b || '", "name_for_human": "' || h || '", "description": "' || s || '"}}' as k from s), {TWO}
select doc_id, {_sql_prompt(prompts.REACT_EN, _sql_tools(prompts.REACT_TOOL["en"]))} as react_en, {_sql_prompt(prompts.REACT_ZH, _sql_tools(prompts.REACT_TOOL["zh"]))} as react_zh, {_sql_prompt(prompts.REACT_GRPO, _sql_tools(prompts.REACT_TOOL["en"]))} as react_grpo,
{_sql_prompt(prompts.QWEN_EN, _sql_tools(prompts.QWEN_TOOL["en"]), "h")} as qwen_en, {_sql_prompt(prompts.QWEN_ZH, _sql_tools(prompts.QWEN_TOOL["zh"]), "h")} as qwen_zh, {_sql_prompt(prompts.QWEN_EN_PARALLEL, _sql_tools(prompts.QWEN_TOOL["en"]), "h")} as qwen_en_many, {_sql_prompt(prompts.QWEN_ZH_PARALLEL, _sql_tools(prompts.QWEN_TOOL["zh"]), "h")} as qwen_zh_many,
{_sql_prompt(prompts.HERMES, f"x || {NL} || y", "h")} as hermes, {_sql_prompt(prompts.YOUTU, f"'```json' || {NL} || x || {NL} || '```' || {NL} || '```json' || {NL} || y || {NL} || '```'", f"h || {NL} || {NL}")} as youtu, {_sql_prompt(prompts.TOOLBENCH, "'[' || j || ', ' || k || ']'")} as toolbench from w""")
def tool_prompt_texts(spark, sf_dir):
    """Whole texts of all tool prompts, as digests; one tool is wrapped, one has a name for readers and no parameters."""
    first = words('{"type":"function","function":{"name":"f_', LANG(), '","description":"', SRC(), '","parameters":{"type":"object","properties":{"a,b":["c:d",1],"e":"', H(), '"}}}}')
    second = words('{"name":"g_', SRC(), '", "name_for_human":"', H(), '","description":"', SRC(), '"}')
    t, s = F.array(first, second), H()
    texts = {"react_en": prompts.react_prompt(t), "react_zh": prompts.react_prompt(t, "zh"), "react_grpo": prompts.react_prompt(t, "grpo"), "hermes": prompts.hermes_prompt(t, s), "youtu": prompts.youtu_prompt(t, s), "toolbench": prompts.toolbench_prompt(t)}
    texts |= {f"qwen_{lang}{'_many' if many else ''}": prompts.qwen_prompt(t, s, many, lang) for lang in ("en", "zh") for many in (False, True)}
    return docs(spark, sf_dir).select("doc_id", *[F.md5(x).alias(name) for name, x in texts.items()])


# -- user code, metrics ------------------------------------------------------------------------


def _grown(row):
    if row["doc_id"] % 5 == 0:
        return None
    if row["doc_id"] % 5 == 1:
        raise ValueError("a bad row")
    out = {"doc_id": row["doc_id"], "word": row["lang"]}
    return [out, {"doc_id": row["doc_id"], "word": row["source"]}] if row["doc_id"] % 5 == 2 else out


@query("select doc_id, lang as word from documents where doc_id % 5 >= 2 union all select doc_id, source from documents where doc_id % 5 = 2")
def user_rows(spark, sf_dir):
    """A user's function of a row: one row, several or none; rows that raise go."""
    return extend.row_transform(docs(spark, sf_dir).select("doc_id", "lang", "source"), _grown, "doc_id long, word string")


def _length_reward(texts, doc_id):
    return [None if i % 3 == 0 else float(len(t)) for t, i in zip(texts, doc_id, strict=True)]


async def _late_reward(texts, doc_id):
    await asyncio.sleep(0)
    return [float(i) for i in doc_id]


@query("select doc_id, case when doc_id % 3 <> 0 then length(lang)::double end as plain, doc_id::double as late from documents")
def user_rewards(spark, sf_dir):
    """Registered rewards, a plain and an asynchronous one; no reward is null."""
    extend.reward("plain")(_length_reward)
    extend.reward("late")(_late_reward)
    return extend.scored(docs(spark, sf_dir).select("doc_id", "lang"), ["plain", "late"], "lang", ("doc_id",)).select("doc_id", "plain", "late")


USER_FILE = """from loomspark.functions import extend


@extend.reward("starts")
def starts(completions, source, **more):
    return [float(s.endswith(t[-1:])) if t else None for t, s in zip(completions, source)]
"""


@query("select doc_id, case when lang <> '' then (right(source, 1) = right(lang, 1))::int::double end as starts from documents")
def loaded_rewards(spark, sf_dir):
    """A reward that a user's own file registers when it is run."""
    with tempfile.TemporaryDirectory() as at:  # only the driver reads the file; its function travels with the job
        path = f"{at}/mine.py"
        with open(path, "w") as f:
            f.write(USER_FILE)
        extend.load_file(path)
    return extend.scored(docs(spark, sf_dir).select("doc_id", "lang", "source"), ["starts"], "lang", ("source",)).select("doc_id", "starts")


@query("select avg(n_chars) as by_state, avg(n_chars) as plain, -1.0::double as none from documents")
def user_metrics(spark, sf_dir):
    """A metric with a state that merges, and a mean with a value for no rows."""
    d = docs(spark, sf_dir).select("n_chars")
    state = spark.createDataFrame([(extend.Mean("n_chars").over(d),)], "by_state double")
    plain = d.agg(metrics.mean_or(F.col("n_chars")).alias("plain"))
    return state.crossJoin(plain).crossJoin(d.where("n_chars < 0").agg(metrics.mean_or(F.col("n_chars"), -1.0).alias("none")))


@query("select list(n_chars order by n_chars desc)[1:3] as longest, count(distinct lang)::double as langs, count(distinct source)::double as sources from documents")
def merged_metrics(spark, sf_dir):
    """Metrics whose states are no sums: the largest values, and distinct values by their least hashes."""
    d = docs(spark, sf_dir).select("n_chars", "lang", "source")
    row = (extend.Largest("n_chars", 3).over(d), extend.Distinct("lang").over(d), extend.Distinct("source").over(d))
    return spark.createDataFrame([row], "longest array<long>, langs double, sources double")


@query("select conv_id, turn, 1.0::double as same_rouge, 1.0::double as same_bleu, 0.0::double as other from conversations where regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
def equal_texts_score(spark, sf_dir):
    """ROUGE-L and BLEU of a text against itself and against none of its words."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    other = F.transform("w", lambda x: F.concat(F.lit("\x01"), x))
    return c.select("conv_id", "turn", F.round(metrics.rouge_l(F.col("w"), F.col("w")), 9).alias("same_rouge"), F.round(metrics.bleu(F.col("w"), F.col("w")), 9).alias("same_bleu"), metrics.rouge_l(F.col("w"), other).alias("other"))


@query(f"with {DOCS} select doc_id, md5('user:' || source || '|assistant:' || h) as first, md5('user:' || source || '|user:' || lang) as second, md5('user:' || source || '|assistant:' || lang) as negative from d")
def attached_answers(spark, sf_dir):
    """Positives and negatives, each as a conversation of its own after the one it belongs to."""
    turn = lambda role, c: F.array(F.array(F.struct(F.lit(role).alias("role"), c.alias("content"))))
    d = docs(spark, sf_dir).select("doc_id", turn("user", SRC())[0].alias("messages"), F.concat(turn("assistant", H()), turn("user", LANG())).alias("positive_messages"), turn("assistant", LANG()).alias("negative_messages"))
    got = encode.attached(encode.attached(d), "negative")
    return got.select("doc_id", F.md5(shown(F.col("positive_messages")[0])).alias("first"), F.md5(shown(F.col("positive_messages")[1])).alias("second"), F.md5(shown(F.col("negative_messages")[0])).alias("negative"))


@query(f"with {DOCS} select doc_id, case when doc_id % 3 = 0 then 1 else 0 end + case when doc_id % 5 = 0 then 1 else 0 end + case when doc_id % 7 = 0 then 1 else 0 end as n, doc_id % 3 = 0 as query, doc_id % 5 = 0 as system from d")
def checked_templates(spark, sf_dir):
    """Templates in a table's rows, and what is wrong with them."""
    bad = lambda n: F.col("doc_id") % n == 0
    faults = render.template_faults(words(SRC(), F.when(bad(3), "{{ASK}}").otherwise("{{QUERY}}")), words(LANG(), F.when(bad(5), "").otherwise("{{SYSTEM}}")), words(LANG(), F.when(bad(7), "{{SYSTEM}}").otherwise("")))
    d = docs(spark, sf_dir).select("doc_id", faults.alias("f"))
    has = lambda t: F.exists("f", lambda x: x.contains(t))
    return d.select("doc_id", F.size("f").alias("n"), has("{{QUERY}}").alias("query"), has("prefix needs").alias("system"))


@query(f"with {DOCS} select doc_id, source as name, n_chars as n, lang as last from d")
def repaired_arguments(spark, sf_dir):
    """Arguments of tool calls that are no JSON, each broken in its own way, and what they were meant to be."""
    n = F.col("n_chars").cast("string")
    forms = [
        words("{'name': '", SRC(), "', 'n': ", n, ", 'tags': ['", LANG(), "']}"), words('```json\n{"name": "', SRC(), '", "n": ', n, ', "tags": ["x", "', LANG(), '",],}\n```'), words('{name: "', SRC(), '" n: ', n, ", tags: [", LANG(), "]}"),
        words('{"name": "', SRC(), '", // it\n"n": ', n, ', "ok": True, "tags": ["', LANG(), '"'), words('{"name": "', SRC(), '", "n": ', n, ', "tags": ["', LANG()), words('{"name": "', SRC(), '", "n": ', n, ', "tags": ["', LANG(), '"]}'),
    ]
    text = F.element_at(F.array(*forms), (F.col("doc_id") % len(forms) + 1).cast("int"))
    j = docs(spark, sf_dir).select("doc_id", jsonfix.repair(text).alias("j"))
    tags = F.from_json(F.get_json_object("j", "$.tags"), "array<string>")
    return j.select("doc_id", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.n").cast("long").alias("n"), F.element_at(tags, -1).alias("last"))


# -- packing, streams --------------------------------------------------------------------------


@query(f"select count(*) as rows, count(*) as members, true as fits, true as sums, sum(len({WORDS}))::bigint as tokens from documents")
def pack_checks(spark, sf_dir):
    """Every row is in one bin; no bin of several rows is over the volume; totals are right."""
    from .data import pack_bins

    p = pack_bins(spark, sf_dir)
    each = p.select(F.explode("members").alias("id")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("members"))
    fits = p.agg(F.bool_and((F.col("total") <= PACK) | (F.size("members") == 1)).alias("fits"), F.bool_and(packing.total_length(F.col("lengths")) == F.col("total")).alias("sums"), F.sum("total").cast("long").alias("tokens"))
    return each.crossJoin(fits)


@query("select part, count(*) as n from (select case when r <= 5 then 'val' else 'train' end as part from (select row_number() over (order by doc_id) as r from documents) where r <= 30) group by part")
def stream_take(spark, sf_dir):
    """The first thirty rows of a stream, five of them to validate."""
    got: list = []
    streams.each(_stream(spark, sf_dir, "documents").select("doc_id"), streams.Take(30, 5, "doc_id", lambda b: got.extend(r["part"] for r in b.collect())))
    return spark.createDataFrame([(p, got.count(p)) for p in sorted(set(got))], "part string, n long")


@query(f"select sum(len({WORDS}))::bigint as tokens, count(*) as rows, true as fits from documents")
def stream_pack(spark, sf_dir):
    """A stream packed by shards, each with its open bin as state; the open bins come last."""
    source = _stream(spark, sf_dir, "documents").select("doc_id", F.size(tokens.words(F.col("text"))).alias("n"), (F.col("doc_id") % SHARDS).alias("shard"))
    base = folder(spark)
    bins = streams.run(streams.packed(source, "shard", "doc_id", "n", PACK), checkpoint=f"{base}/checkpoint")
    bins = bins.unionByName(streams.packed_rest(spark, f"{base}/checkpoint"))
    fits = F.bool_and((F.col("total") <= PACK) | (F.size("members") == 1))
    return bins.agg(F.sum("total").alias("tokens"), F.sum(F.size("members")).cast("long").alias("rows"), fits.alias("fits"))


@query(f"select doc_id % {SHARDS} as shard, count(*) as rows, count(*) as places, 0::bigint as first, count(*) - 1 as last, sum(doc_id)::bigint as ids, sum(doc_id * (doc_id % 1009))::bigint as checksum from documents group by all")
def stream_shuffle(spark, sf_dir):
    """A stream shuffled through buffers of a thousand rows: every row once, at a place of its own."""
    source = _stream(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % SHARDS).alias("shard"))
    base = folder(spark)
    rows = streams.run(streams.shuffled(source, "shard", "doc_id"), checkpoint=f"{base}/checkpoint")
    rows = rows.unionByName(streams.shuffled_rest(spark, f"{base}/checkpoint")).withColumn("id", F.get_json_object("row", "$.doc_id").cast("long"))
    sums = F.sum("id").alias("ids"), F.sum(F.col("id") * (F.col("id") % 1009)).alias("checksum")
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.countDistinct("pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"), *sums)


@query(f"with d as (select len({WORDS}) as n, ntile({SHARDS}) over (order by doc_id) - 1 as segment from documents) select segment, count(*) as rows, count(*) as members, sum(n)::bigint as tokens, true as fits from d group by segment")
def packed_in_order(spark, sf_dir):
    """Segments of consecutive rows, packed with the last bin of a chunk carried into the next."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.words(F.col("text"))).cast("long").alias("n"))
    p = packing.pack_in_order(d, "doc_id", "n", PACK, chunk=100, segments=SHARDS)
    fits = F.bool_and((F.col("total") <= PACK) | (F.size("members") == 1))
    each = p.select("segment", F.explode("members").alias("id")).groupBy("segment").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("members"))
    return p.groupBy("segment").agg(F.sum("total").alias("tokens"), fits.alias("fits")).join(each, "segment").select("segment", "rows", "members", "tokens", "fits")


@query("select doc_id, doc_id % 2 = 0 as complete from documents")
def complete_traces(spark, sf_dir):
    """Multi-turn traces with a mask and a log-probability for each token."""
    one = F.array(F.array(F.lit(1), F.lit(0)))
    probs = F.array(F.when(EVEN(), F.array(F.lit(0.5), F.lit(0.1))).otherwise(F.array(F.lit(0.5))))
    return docs(spark, sf_dir).select("doc_id", streams.loop_complete(F.array("h"), one, probs).alias("complete"))
