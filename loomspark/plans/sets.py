"""Queries over data-set recipes: rows of a recipe's layout are made of documents, and come out as messages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import recipes
from .chat import CONV, conversations
from .registry import query, table

#: Documents in DuckDB: the text as its digest.
DOCS = "d as (select doc_id, source, lang, n_chars, md5(coalesce(text, '')) as h from documents)"
H, SRC, LANG, ID = (partial(F.col, c) for c in ("h", "source", "lang", "doc_id"))


def EVEN() -> Column:  # noqa: N802
    return F.col("doc_id") % 2 == 0


NL = "chr(10)"


def docs(spark, sf_dir, **columns: Column) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return base.select("*", *[c.alias(n) for n, c in columns.items()])


def shown(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("~")))), "|")


def digest(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select("doc_id", F.md5(shown(F.col("messages"))).alias("digest"), *more)


def asked(query_: str, answer: str | None = None) -> str:
    """SQL of the digest of a question and its answer."""
    return f"md5('user:' || {query_}" + (f" || '|assistant:' || {answer})" if answer else ")")


def sql(select: str, more: str = "") -> str:
    return f"with {DOCS} select doc_id, {select} from d{more}"


def pair(user: Column, answer: Column, keys: tuple[str, str] = ("from", "value"), roles: tuple[str, str] = ("user", "assistant")) -> Column:
    return F.array(*[F.struct(F.lit(r).alias(keys[0]), c.alias(keys[1])) for r, c in zip(roles, (user, answer), strict=True)])


def words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# -- text ------------------------------------------------------------------------------------


@query(sql(f"{asked(f'source || {NL} || lang', 'h')} as digest"))
def recipe_alpaca_prefix(spark, sf_dir):
    d = docs(spark, sf_dir, instruction=SRC(), input=F.when(EVEN(), words("输入：", LANG())).otherwise(LANG()), output=H())
    return digest(recipes.alpaca_prefix(d.select("doc_id", "instruction", "input", "output")))


@query(sql(f"{asked('source', 'h')} as digest"))
def recipe_long_answer(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", SRC().alias("query"), F.when(EVEN(), words("Answer:  ", H(), " ")).otherwise(H()).alias("response"))
    return digest(recipes.long_answer(d))


@query(sql("md5('assistant:' || case when doc_id % 2 = 0 then ' ' || h || '，' || lang else h end) as digest"))
def recipe_titled_jokes(spark, sf_dir):
    d = docs(spark, sf_dir, title=F.when(EVEN(), words(ID().cast("string"), ". ", H())).otherwise(H()), abs=F.when(EVEN(), LANG()).otherwise(""))
    return digest(recipes.titled_jokes(d))


@query(sql(f"{asked('lang', 'h')} as digest"))
def recipe_query_response(spark, sf_dir):
    return digest(recipes.query_response(docs(spark, sf_dir), "lang", "h"))


@query(f"""with {CONV}, c as (select conv_id, m, case when m[1].role = 'system' and m[1].content = 'You are a helpful assistant.' then m[2:] else m end as r from conv)
select conv_id, len(r)::bigint as n_turns, md5(array_to_string(list_transform(r, lambda x: x.role || ':' || x.content), '|')) as digest from c
where len(list_filter(r, lambda x: regexp_matches(lower(x.content), 'moss|human:|assistant:|user:'))) = 0""")
def recipe_clean_bench(spark, sf_dir):
    turn = lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value"))
    got = recipes.clean_bench(conversations(spark, sf_dir).select("conv_id", F.transform("messages", turn).alias("messages")))
    return got.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.md5(shown(F.col("messages"))).alias("digest"))


@query(sql("""md5('system:1. {"plugin_name": "' || source || '"} 2. {"plugin_name": "' || lang || '"}|user:' || lang || '|assistant:' || h) as digest""", " where doc_id % 2 = 0"))
def recipe_several_plugins(spark, sf_dir):
    """Odd rows name one plugin twice."""
    system = words('1. {"plugin_name": "', SRC(), '"} 2. {"plugin_name": "', F.when(EVEN(), LANG()).otherwise(SRC()), '"}')
    turns = F.concat(F.array(F.struct(F.lit("system").alias("from"), system.alias("value"))), pair(LANG(), H()))
    return digest(recipes.several_plugins(docs(spark, sf_dir).select("doc_id", turns.alias("messages"))))


@query(sql("source, lang", " where lang in ('en', 'fr')"))
def recipe_in_categories(spark, sf_dir):
    return recipes.in_categories(docs(spark, sf_dir), "lang", ["en", "fr"]).select("doc_id", "source", "lang")


@query(sql(asked(f"'Sql Table information:' || {NL} || source || {NL} || lang", f"'Let''s think step by step:' || {NL} || h || {NL} || 'So the final sql is:' || {NL} || 'select ' || doc_id") + " as digest"))
def recipe_text_to_sql(spark, sf_dir):
    return digest(recipes.text_to_sql(docs(spark, sf_dir, sql_context=SRC(), sql_prompt=LANG(), sql_explanation=H(), sql=words("select ", ID().cast("string")))))


@query(sql(f"{asked('source', 'h')} as digest", " where doc_id % 3 <> 0"))
def recipe_two_turn_tools(spark, sf_dir):
    """Every third row has three turns."""
    two = pair(SRC(), H(), roles=("user", "caller"))
    three = F.concat(two, F.array(F.struct(F.lit("observation").alias("from"), LANG().alias("value"))))
    return digest(recipes.two_turn_tools(docs(spark, sf_dir).select("doc_id", F.when(ID() % 3 == 0, three).otherwise(two).alias("messages"))))


@query(sql(asked("source", f"h || {NL} || {NL} || 'Answer: ' || lang") + " as digest"))
def recipe_appended_answer(spark, sf_dir):
    return digest(recipes.appended_answer(docs(spark, sf_dir, query=SRC(), output=H(), answer=LANG())))


@query(sql(f"md5('assistant:' || lang || {NL} || source || {NL} || h[1:4] || case when doc_id % 2 = 0 then h[5:8] else '' end || h) as digest"))
def recipe_law_chapters(spark, sf_dir):
    d = docs(spark, sf_dir, type=LANG(), title=SRC(), chapter1=F.substring("h", 1, 4), chapter2=F.when(EVEN(), F.substring("h", 5, 4)), response=H())
    return digest(recipes.law_chapters(d))


@query(sql(asked("source", f"'```python' || lang || {NL} || {NL} || h") + " as digest", " where doc_id % 3 <> 0"))
def recipe_code_answer(spark, sf_dir):
    """Every third row has no code fence; some questions are comments."""
    text = words(F.when(EVEN(), "# ").otherwise(""), SRC(), F.when(ID() % 3 != 0, "```python").otherwise(""), LANG(), " ")
    return digest(recipes.code_answer(docs(spark, sf_dir, code_with_problem=text, explanation_only=H())))


@query(sql(f"{asked('source')} as digest, lang as positive, n_chars::double as label", " where n_chars >= 300"))
def recipe_sentence_pairs(spark, sf_dir):
    got = recipes.sentence_pairs(docs(spark, sf_dir, sentence1=SRC(), sentence2=LANG(), score=F.col("n_chars")), 300.0)
    return digest(got, F.col("positive_messages")[0][0]["content"].alias("positive"), "label")


SCORE = f"'Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || {NL} || 'Sentence 1: ' || source || {NL} || 'Sentence 2: ' || lang || {NL} || 'Similarity score: '"


@query(sql(asked(SCORE, "printf('%.1f', (doc_id % 50) / 10.0::double)") + f" as digest, {asked(SCORE)} as number_digest, (doc_id % 50) / 10.0::double as label"))
def recipe_sentence_score(spark, sf_dir):
    """The score as text, and as a label."""
    d = docs(spark, sf_dir, sentence1=SRC(), sentence2=LANG(), score=(ID() % 50) / 10.0)
    number = digest(recipes.sentence_score(d, True), "label").withColumnRenamed("digest", "number_digest")
    return digest(recipes.sentence_score(d)).join(number, "doc_id")


@query(sql(f"{asked('source')} as digest, 1::bigint as n_pos, 2::bigint as n_neg, 'assistant:' || lang as positive, 'assistant:' || h as negative"))
def recipe_rerank_lists(spark, sf_dir):
    got = recipes.rerank_lists(docs(spark, sf_dir, query=SRC(), positive=LANG(), negative=F.array("source", "h")))
    return digest(got, F.size("positive_messages").cast("long").alias("n_pos"), F.size("negative_messages").cast("long").alias("n_neg"), shown(F.col("positive_messages")[0]).alias("positive"), shown(F.col("negative_messages")[1]).alias("negative"))


@query(sql(f"{asked('source', 'h')} as digest", " where doc_id % 5 <> 0"))
def recipe_repaired_messages(spark, sf_dir):
    """Message lists without commas; every fifth is unreadable."""
    text = words("[{'from': 'user', 'value': '", SRC(), "'} {'from': 'assistant', 'value': '", H(), F.when(ID() % 5 == 0, "'").otherwise("'}]"))
    return digest(recipes.repaired_messages(docs(spark, sf_dir).select("doc_id", text.alias("conversations"))))


@query(sql("md5('system:|user:' || source || '|assistant:' || h) as digest", " where doc_id % 2 = 0"))
def recipe_room_chat(spark, sf_dir):
    """Rooms that open with a system turn ask nothing and go."""
    turn = lambda who, text: F.struct(who.alias("from"), text.alias("value"))
    room = F.array(turn(F.when(EVEN(), "user").otherwise("system"), SRC()), turn(F.lit("bob"), LANG()), turn(F.lit("alice"), H()))
    return digest(recipes.room_chat(docs(spark, sf_dir).select("doc_id", room.alias("conversations"))))


@query(sql(asked(f"""'Using the numbers [' || doc_id || ', ' || n_chars || '], create an equation that equals ' || (doc_id + 1) || '.' || {NL} || 'You can use basic arithmetic operations (+, -, *, /) and each number can only be used once.' || {NL} || 'Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.'""") + " as digest"))
def recipe_countdown(spark, sf_dir):
    return digest(recipes.countdown(docs(spark, sf_dir, nums=F.array("doc_id", "n_chars"), target=ID() + 1)))


WHO = f"'Classification Task: Are the following responses from a human or from ChatGPT?' || {NL} || 'Question: ' || q || {NL} || 'Answer: ' || a || {NL} || 'Category: Human, ChatGPT' || {NL} || 'Output:'"


@query(f"with {DOCS}, x as (select source || doc_id as q, lang as a, 0 as label from d union all select source || doc_id, h, 1 from d where doc_id % 2 = 0) select q as question, label, " + asked(WHO, "case label when 0 then 'Human' else 'ChatGPT' end") + " as digest from x")
def recipe_human_or_model(spark, sf_dir):
    """Odd rows have no model answer."""
    d = docs(spark, sf_dir, question=words(SRC(), ID().cast("string")), human_answers=F.array("lang"), chatgpt_answers=F.when(EVEN(), F.array("h")).otherwise(F.array().cast("array<string>")))
    return recipes.human_or_model(d).select("question", "label", F.md5(shown(F.col("messages"))).alias("digest"))


@query(sql(asked(f"'Task: Question Generation' || {NL} || 'Context: ' || lang || {NL} || 'Answer: ' || source || {NL} || 'Question:'", "h") + " as digest", " where doc_id % 2 = 0"))
def recipe_question_generation(spark, sf_dir):
    return digest(recipes.question_generation(docs(spark, sf_dir, text1=words(SRC(), F.when(EVEN(), "[SEP]").otherwise(""), LANG()), text2=H())))


@query(sql("""md5('user:' || source || '|tool_call:{"name":"' || lang || '","arguments":"{\\"x\\":' || doc_id || '}"}') as digest, 'Action: ' || lang || chr(10) || 'Action Input: {"x":' || doc_id || '}' as solution"""))
def recipe_tool_calls(spark, sf_dir):
    """A JSON list of calls as turns, and as a solution."""
    d = docs(spark, sf_dir, query=SRC(), answers=words('[{"name":"', LANG(), '","arguments":{"x":', ID().cast("string"), "}}]"))
    solved = recipes.tool_call_solution(d).select("doc_id", "solution")
    return digest(recipes.json_tool_calls(d)).join(solved, "doc_id")


@query(sql(f"md5('user:' || source || '|assistant:' || lang || '|user:' || source || '|assistant:' || h) as digest, lang as rejected"))
def recipe_nested_preference(spark, sf_dir):
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    d = docs(spark, sf_dir, context=F.array(turn("human", SRC()), turn("bot", LANG()), turn("human", SRC())), chosen=F.struct(H().alias("text")), rejected=F.struct(LANG().alias("text")))
    return digest(recipes.nested_preference(d), F.col("rejected_response").alias("rejected"))


@query(sql("source || '❤' as prompt, h as chosen, lang as rejected"))
def recipe_plain_emoji(spark, sf_dir):
    d = docs(spark, sf_dir, prompt=words(SRC(), "❤️"), chosen=H(), rejected=words(LANG(), "️"))
    return recipes.plain_emoji(d).select("doc_id", "prompt", "chosen", "rejected")


@query(sql("md5(case when doc_id % 2 = 0 then 'user:' || source || chr(10) || '|assistant:' || lang || '|' else '' end || 'user:' || h || '|assistant:' || lang) as digest", " where doc_id % 6 <> 4"))
def recipe_marked_history(spark, sf_dir):
    """Odd rows have no earlier rounds; some end with a user's mark and go."""
    past = F.when(ID() % 6 == 4, words("User:", SRC())).when(EVEN(), words("User:", SRC(), "\nAssistant:", LANG())).otherwise("")
    return digest(recipes.marked_history(docs(spark, sf_dir, instruction=past, input=F.when(EVEN(), words("User:", H())).otherwise(H()), output=LANG())))


@query(sql(f"{asked('source', 'h')} as digest, 2::bigint as n_tools, lang as first_tool"))
def recipe_described_functions(spark, sf_dir):
    turns = F.concat(F.array(F.struct(F.lit("system").alias("from"), LANG().alias("value"))), pair(SRC(), H()))
    got = recipes.described_functions(docs(spark, sf_dir).select("doc_id", turns.alias("messages"), words(LANG(), "\n\n", SRC()).alias("function_description")))
    return digest(got, F.size("tools").cast("long").alias("n_tools"), F.get("tools", 0).alias("first_tool"))


@query(sql("lang", " where source <> 'src1'"))
def recipe_without_source(spark, sf_dir):
    return recipes.without_source(docs(spark, sf_dir), "source", "src1").select("doc_id", "lang")


@query(sql(asked("'who is ' || case when doc_id % 2 = 0 then '小织' else 'Loom' end || '? please'", "'ok: ' || case when doc_id % 2 = 0 then '队' else 'Team' end || ' made ' || case when doc_id % 2 = 0 then '小织' else 'Loom' end || h") + " as digest"))
def recipe_self_cognition(spark, sf_dir):
    d = docs(spark, sf_dir, query=F.lit("who is {{NAME}}?"), response=words("{{AUTHOR}} made {{NAME}}", H()), tag=F.when(EVEN(), "zh").otherwise("en"))
    return digest(recipes.self_cognition(d, ("小织", "Loom"), ("队", "Team"), " please", "ok: "))


# -- images, video, sound ----------------------------------------------------------------------


DRAWN = "['a?', 'b?', 'c?'][(('0x' || md5('question:' || doc_id)[1:8])::bigint % 3 + 1)::int]"


@query(sql(asked("'What is it?'", "h") + f" as digest, {asked(DRAWN, 'h')} as drawn"))
def recipe_image_questions(spark, sf_dir):
    """One fixed question, and one drawn by hash."""
    d = docs(spark, sf_dir)
    drawn = digest(recipes.drawn_question(d, ["a?", "b?", "c?"], "doc_id", "h")).withColumnRenamed("digest", "drawn")
    return digest(recipes.fixed_question(d, "What is it?", "h")).join(drawn, "doc_id")


@query(f"with {DOCS} select doc_id, 'root/' || lang || '/' || source as image, case lang when 'en' then 'a/' else 'b/' end || lang || '/' || source as routed from d where lang in ('en', 'fr')")
def recipe_paths(spark, sf_dir):
    """Listed paths under a folder; folders by the first part of a path."""
    d = docs(spark, sf_dir).select("doc_id", words(LANG(), "/", SRC()).alias("image"))
    files = docs(spark, sf_dir).where("lang in ('en', 'fr')").select(words("root/", LANG(), "/", SRC()).alias("path"))
    routed = recipes.routed_paths(d, "image", {"en": "a/", "fr": "b"}).withColumnRenamed("image", "routed")
    return recipes.rooted_paths(d, "image", "root/", files).join(routed, "doc_id").select("doc_id", "image", "routed")


@query(sql("source as first, h as caption, lang || source as spoken"))
def recipe_captions(spark, sf_dir):
    """The first of several answers, a caption without its lead, speech without spaces."""
    d = docs(spark, sf_dir).select("doc_id", words(" ", SRC(), "&&", LANG()).alias("first"), F.when(EVEN(), words("caption: ", H())).otherwise(H()).alias("caption"), words(LANG(), " ", SRC(), " ").alias("spoken"))
    return recipes.spoken_text(recipes.stripped_caption(recipes.first_of(d, "first"), "caption", "caption:"), "spoken").select("doc_id", "first", "caption", "spoken")


@query(sql(asked(f"source || {NL} || 'A. ' || h || {NL} || 'B. ' || doc_id", "case when doc_id % 2 = 0 then 'A' else 'B' end") + " as digest, " + asked("source", "case when doc_id % 2 = 0 then h else doc_id::varchar end") + " as indexed", " where lang in ('en', 'fr')"))
def recipe_choices(spark, sf_dir):
    """Options as letters, and as an index; videos that are not listed go."""
    both = F.array(H(), ID().cast("string"))
    d = docs(spark, sf_dir, question=SRC(), options=both, choices=both, video=LANG())
    videos = table(spark, sf_dir, "documents").select(F.col("lang").alias("video")).where("video in ('en', 'fr')")
    lettered = digest(recipes.lettered_options(d.withColumn("answer", F.when(EVEN(), H()).otherwise(ID().cast("string"))), videos))
    indexed = digest(recipes.indexed_choice(d.withColumn("answer", (ID() % 2).cast("int")))).withColumnRenamed("digest", "indexed")
    return lettered.join(indexed, "doc_id")


@query(sql(asked("case when doc_id % 3 = 0 then lang else source end", "h") + f" as digest, {asked(chr(39) + 'What is the caption of the image?' + chr(39), 'h')} as caption, 'user:' || h as positive", " where doc_id % 6 <> 0"))
def recipe_first_question(spark, sf_dir):
    """The first question that is there; rows without any go. Captions as answers and as positives."""
    d = docs(spark, sf_dir, q1=F.when(ID() % 3 != 0, SRC()), q2=F.when(ID() % 6 != 0, LANG()), captions=F.array("h", "lang"))
    cap = digest(recipes.caption_pair(d)).withColumnRenamed("digest", "caption")
    pos = recipes.caption_pair(d, True).select("doc_id", shown(F.col("positive_messages")[0]).alias("positive"))
    return digest(recipes.first_question(d, ["q1", "q2"], "h")).join(cap, "doc_id").join(pos, "doc_id")


@query(sql(asked("'<image>Locate <ref-object> in the image.'", "'<bbox>'") + f" as digest, {asked(chr(39) + '<image>Describe <bbox> in the image.' + chr(39), chr(39) + '<ref-object>' + chr(39))} as caption, source as ref"))
def recipe_grounded(spark, sf_dir):
    d = docs(spark, sf_dir, ref=SRC(), bbox=F.array(*[F.lit(float(i)) for i in (1, 2, 30, 40)]))
    cap = digest(recipes.grounded(d, "caption")).withColumnRenamed("digest", "caption")
    return digest(recipes.grounded(d), F.col("objects.ref")[0].alias("ref")).join(cap, "doc_id")


@query(sql(asked("'<image>Describe the image with boxes.'", "h[1:2] || '<ref-object><bbox>' || h[6:8] || '<ref-object><bbox>' || h[13:]") + " as digest, h[3:5] || ',' || h[9:12] as refs", " where doc_id % 2 = 0"))
def recipe_grounded_phrases(spark, sf_dir):
    """Spans of odd rows overlap."""
    span = lambda s, e, b: F.struct(F.lit(s).alias("start"), (e if isinstance(e, Column) else F.lit(e)).alias("end"), F.array(F.lit(b)).alias("box"))
    d = docs(spark, sf_dir, caption=H(), spans=F.array(span(8, 12, 2.0), span(2, F.when(EVEN(), 5).otherwise(9), 1.0)))
    return digest(recipes.grounded_phrases(d), F.array_join("objects.ref", ",").alias("refs"))


@query(sql(asked("source || ' Think.'") + " as digest, h as solution, (case when doc_id % 2 = 0 then '0' else '' end || case when doc_id % 2 = 0 and doc_id % 3 = 0 then ',' else '' end || case when doc_id % 3 = 0 then '1' else '' end) as label"))
def recipe_labels(spark, sf_dir):
    """0/1 columns as class numbers; problems with a suffix."""
    d = docs(spark, sf_dir, problem=SRC(), a=EVEN().cast("int"), b=(ID() % 3 == 0).cast("int"))
    got = recipes.asked_with(recipes.multilabel(d, ["a", "b"]), " Think.", "h")
    return digest(got, "solution", F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("label"))
