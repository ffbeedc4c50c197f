"""Transforms of particular data sets, each a function of a DataFrame; compositions of the other operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.delimit import by_keywords, stripped
from ..schema import PLAIN_MESSAGE
from .normalize import bbox, from_alpaca, from_messages, from_response, message, messages_of, pick
from .sampling import draw_order

RECIPES: dict[str, Callable[..., DataFrame]] = {}


def recipe(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    RECIPES[f.__name__] = f
    return f


def turns(*pairs: tuple[str, Column | str]) -> Column:
    return F.array(*[message(role, F.lit(c) if isinstance(c, str) else c) for role, c in pairs])


def _ask(df: DataFrame, query: Column | str, answer: Column) -> DataFrame:
    return df.withColumn("messages", turns(("user", query), ("assistant", answer)))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# -- text ------------------------------------------------------------------------------------


@recipe
def alpaca_prefix(df: DataFrame, prefix: str = "输入：") -> DataFrame:
    """Inputs without their leading mark."""
    return from_alpaca(df.withColumn("input", F.when(F.col("input").startswith(prefix), F.expr(f"substring(input, {len(prefix) + 1})")).otherwise(F.col("input"))))


@recipe
def long_answer(df: DataFrame, prefix: str = "Answer: ") -> DataFrame:
    out = F.col("response")
    return from_response(df.withColumn("response", stripped(F.when(out.startswith(prefix), F.expr(f"substring(response, {len(prefix) + 1})")).otherwise(out))))


@recipe
def titled_jokes(df: DataFrame) -> DataFrame:
    """title (or content) with its abstract, without a leading number, as one answer."""
    have = set(df.columns)
    title = F.coalesce(*[F.col(c) for c in ("title", "content") if c in have])
    if "abs" in have:
        title = F.when(_filled(F.col("abs")) & (F.col("abs") != title), F.concat(title, F.lit("，"), F.col("abs"))).otherwise(title)
    numbered = F.regexp_extract(title, r"\d+[\.,\s,、](.+)", 1)
    text = F.when(numbered != "", numbered).otherwise(title)
    return df.withColumn("messages", turns(("assistant", text))).where(_filled(text))


@recipe
def query_response(df: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    return _ask(df, F.col(query), F.col(response))


@recipe
def clean_bench(df: DataFrame, system: str = "You are a helpful assistant.") -> DataFrame:
    """from/value turns without the usual system turn; conversations that quote role marks go."""
    m = F.col("messages")
    head = (F.get(m, 0)["from"] == "system") & (F.get(m, 0)["value"] == system)
    df = df.withColumn("messages", F.when(head, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m))
    bad = F.exists("messages", lambda t: F.lower(t["value"]).rlike("moss|human:|assistant:|user:"))
    return from_messages(df.where(~bad))


@recipe
def several_plugins(df: DataFrame) -> DataFrame:
    """Conversations whose system turn names two plugins or more."""
    head = F.get("messages", 0)
    names = F.array_distinct(F.regexp_extract_all(head["value"], F.lit(r'\d\. \{"plugin_name": "(.+?)"'), 1))
    return from_messages(df.where((head["from"] == "system") & (F.size(names) >= 2)))


@recipe
def in_categories(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(allowed))


@recipe
def text_to_sql(df: DataFrame) -> DataFrame:
    query = F.concat(F.lit("Sql Table information:\n"), F.col("sql_context"), F.lit("\n"), F.col("sql_prompt"))
    answer = F.concat(F.lit("Let's think step by step:\n"), F.col("sql_explanation"), F.lit("\nSo the final sql is:\n"), F.col("sql"))
    return _ask(df, query, answer)


@recipe
def two_turn_tools(df: DataFrame) -> DataFrame:
    """Exactly two turns; caller and conclusion answer."""
    return from_messages(df.where(F.size("messages") == 2), assistants=("assistant", "gpt", "bot", "caller", "conclusion"))


@recipe
def appended_answer(df: DataFrame) -> DataFrame:
    return _ask(df, F.col("query"), F.concat(F.col("output"), F.lit("\n\nAnswer: "), F.col("answer")))


@recipe
def law_chapters(df: DataFrame) -> DataFrame:
    """Kind and title on lines of their own, then the chapters that are there and the text."""
    parts = [F.coalesce(F.col(f"chapter{i}"), F.lit("")) for i in (1, 2, 3) if f"chapter{i}" in df.columns]
    return df.withColumn("messages", turns(("assistant", F.concat(F.col("type"), F.lit("\n"), F.col("title"), F.lit("\n"), *parts, F.col("response")))))


@recipe
def code_answer(df: DataFrame, column: str = "code_with_problem") -> DataFrame:
    """The text before the first code fence asks, the fence and what follows answers."""
    at = F.instr(column, "```python")
    head = F.substring(F.col(column), F.lit(1), at - 1)
    code = stripped(F.substring(F.col(column), at, F.length(column)))
    return _ask(df.where(at > 0), F.when(head.startswith("# "), F.expr(f"substring(substring({column}, 1, instr({column}, '```python') - 1), 3)")).otherwise(head), F.concat(code, F.lit("\n\n"), F.col("explanation_only")))


@recipe
def sentence_pairs(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Anchor and positive sentence; pairs below a threshold go, others keep their score as label."""
    out = df.withColumn("messages", turns(("user", F.col("sentence1")))).withColumn("positive_messages", F.array(F.array(F.struct(F.lit("user").alias("role"), F.col("sentence2").alias("content"))))).withColumn("label", F.col("score").cast("double"))
    return out if threshold is None else out.where(F.col("label") >= threshold)


@recipe
def sentence_score(df: DataFrame, regression: bool = False) -> DataFrame:
    """Similarity as text with one decimal, or as a number."""
    ask = F.format_string("Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.\nSentence 1: %s\nSentence 2: %s\nSimilarity score: ", F.col("sentence1"), F.col("sentence2"))
    if regression:
        return df.withColumn("messages", turns(("user", ask))).withColumn("label", F.col("score").cast("double"))
    return _ask(df, ask, F.format_string("%.1f", F.col("score").cast("double")))


@recipe
def rerank_lists(df: DataFrame) -> DataFrame:
    """query with positive and negative texts (one or many) as message lists."""
    lists = {}
    for c in ("positive", "negative"):
        col = F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(c)
        lists[f"{c}_messages"] = F.transform(col, lambda t: F.array(F.struct(F.lit("assistant").alias("role"), t.alias("content"))))
    return df.withColumn("messages", turns(("user", F.col("query")))).withColumns(lists)


@F.pandas_udf(T.ArrayType(PLAIN_MESSAGE))
def repaired_literal(text: pd.Series) -> pd.Series:
    """Python-literal message lists with commas missing between dicts; unreadable ones are null."""
    import ast
    import re

    def read(s):
        try:
            got = ast.literal_eval(re.sub(r"\}\s*\{", "}, {", s))
            return [{"role": m.get("role", m.get("from")), "content": m.get("content", m.get("value"))} for m in got]
        except (ValueError, SyntaxError, TypeError, AttributeError):
            return None

    return text.map(read)


@recipe
def repaired_messages(df: DataFrame, column: str = "conversations") -> DataFrame:
    out = df.withColumn("messages", repaired_literal(F.col(column))).where("messages is not null")
    return out.withColumn("messages", messages_of(F.col("messages"), ["role", "content"]))


@recipe
def room_chat(df: DataFrame, notice: str = "", history: str = "\n\n【chat history】") -> DataFrame:
    """A room of speakers folded into the system text; the last turn answers."""
    c = F.col("conversations")
    head, last = F.get(c, 0), F.element_at(c, -1)["value"]
    system = F.when(head["from"] == "system", head["value"]).otherwise("")
    query = F.when(head["from"] == "user", head["value"]).otherwise("")
    lines = F.array_join(F.transform(F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))), lambda t: F.concat(F.lit("\n "), t["from"], F.lit(":"), t["value"])), "")
    noted = F.when((system != "") & ~F.contains(system, F.lit("【注意事项】")), F.concat(system, F.lit(notice))).otherwise(system)
    folded = F.when((query == "") & ~F.contains(system, F.lit("next_speakers:")), F.concat(noted, F.lit(history), lines)).otherwise(system)
    return df.withColumn("messages", turns(("system", folded), ("user", query), ("assistant", last))).where(_filled(query) & _filled(last))


@recipe
def countdown(df: DataFrame) -> DataFrame:
    ask = F.concat(F.lit("Using the numbers ["), F.array_join(F.transform("nums", lambda n: n.cast("string")), ", "), F.lit("], create an equation that equals "), F.col("target").cast("string"), F.lit(".\nYou can use basic arithmetic operations (+, -, *, /) and each number can only be used once.\nShow your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>."))
    return df.withColumn("messages", turns(("user", ask)))


@recipe
def human_or_model(df: DataFrame, generate: bool = True) -> DataFrame:
    """One question with a human and a model answer (arrays, one is drawn by hash) -> two rows."""
    draw = lambda c: F.get(F.col(c), F.pmod(F.xxhash64(F.col("question"), F.lit(c)), F.greatest(F.size(c), F.lit(1))).cast("int"))
    rows = df.select("question", F.explode(F.array(F.struct(draw("human_answers").alias("a"), F.lit(0).alias("label")), F.struct(draw("chatgpt_answers").alias("a"), F.lit(1).alias("label")))).alias("x"))
    rows = rows.select("question", "x.*").where("a is not null")
    query = F.format_string("Classification Task: Are the following responses from a human or from ChatGPT?\nQuestion: %s\nAnswer: %s\nCategory: Human, ChatGPT\nOutput:", F.col("question"), F.col("a"))
    return _ask(rows, query, F.element_at(F.array(F.lit("Human"), F.lit("ChatGPT")), F.col("label") + 1)) if generate else rows.withColumn("messages", turns(("user", query)))


@recipe
def question_generation(df: DataFrame) -> DataFrame:
    cut = F.split("text1", r"\[SEP\]")
    ask = F.concat(F.lit("Task: Question Generation\nContext: "), F.get(cut, 1), F.lit("\nAnswer: "), F.get(cut, 0), F.lit("\nQuestion:"))
    return _ask(df.where(F.size(cut) == 2), ask, F.col("text2"))


def dialogue(text: Column) -> Column:
    """Human / Assistant text -> alternating turns; an odd last turn goes."""
    cut = F.transform(F.split(stripped(text), r"\n\nHuman:|\n\nAssistant:|\n\nHum:"), stripped)
    cut = F.transform(cut, lambda p, i: F.when((i == 0) & p.startswith("Human:"), stripped(F.regexp_replace(p, "^Human:", ""))).otherwise(p))
    even = (F.size(cut) / 2).cast("int") * 2
    return F.transform(F.slice(cut, 1, even), lambda p, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), p))


@recipe
def preference_dialogues(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", dialogue(F.col("chosen"))).withColumn("rejected_messages", dialogue(F.col("rejected")))


@recipe
def json_tool_calls(df: DataFrame) -> DataFrame:
    """A JSON array of calls: one tool_call turn each."""
    calls = F.from_json("answers", "array<struct<name:string,arguments:string>>")
    return df.withColumn("messages", F.concat(turns(("user", F.col("query"))), F.transform(calls, lambda c: message("tool_call", F.to_json(c)))))


@recipe
def tool_call_solution(df: DataFrame) -> DataFrame:
    """One call, drawn by hash, as Action text in solution."""
    calls = F.from_json("answers", "array<struct<name:string,arguments:string>>")
    one = F.get(calls, F.pmod(F.xxhash64("query"), F.greatest(F.size(calls), F.lit(1))).cast("int"))
    return df.withColumn("messages", turns(("user", F.col("query")))).withColumn("solution", F.concat(F.lit("Action: "), one["name"], F.lit("\nAction Input: "), one["arguments"]))


@recipe
def nested_preference(df: DataFrame) -> DataFrame:
    """context turns, chosen and rejected {text}: the chosen one closes the conversation."""
    names = df.schema["context"].dataType.elementType.names
    if "text" in names:
        past = F.transform("context", lambda t: message(F.when(t["role"].isin("human", "user"), "user").otherwise("assistant"), t["text"]))
    else:
        past = messages_of(F.col("context"), names)
    return df.withColumn("messages", F.concat(past, F.array(message("assistant", F.col("chosen.text"))))).withColumn("rejected_response", F.col("rejected.text"))


@recipe
def plain_emoji(df: DataFrame, columns: tuple[str, ...] = ("prompt", "chosen", "rejected")) -> DataFrame:
    """Without the variation selector."""
    return df.withColumns({c: F.replace(F.col(c), F.lit("️"), F.lit("")) for c in columns})


@recipe
def marked_history(df: DataFrame) -> DataFrame:
    """User / Assistant marks in the instruction are earlier rounds; they must alternate and be filled."""
    marks = ["User:", "User：", "Assistant：", "Assistant:", "Asssistent:", "Assistent:", "Assistenz:"]
    cut = by_keywords(F.col("instruction"), marks)
    fits = F.forall(F.transform(cut, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.when(x["i"] % 2 == 0, F.contains(F.lower(x["p"]["key"]), F.lit("user"))).otherwise(F.lower(x["p"]["key"]).rlike("assist|asssist")) & (x["p"]["content"] != ""))
    past = F.transform(cut, lambda p, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), p["content"]))
    query = F.when(F.col("input").startswith("User:"), stripped(F.regexp_replace("input", "^User:", ""))).otherwise(F.col("input"))
    none = ~_filled(F.col("instruction"))
    base = turns(("user", query), ("assistant", F.col("output")))
    return df.where(none | (fits & (F.size(cut) % 2 == 0))).withColumn("messages", F.when(none, base).otherwise(F.concat(past, base)))


@recipe
def described_functions(df: DataFrame) -> DataFrame:
    """Tools from blank-line separated descriptions; no system turn."""
    out = from_messages(df)
    if "function_description" in df.columns:
        out = out.withColumn("tools", F.when(_filled(F.col("function_description")), F.split("function_description", "\n\n")))
    return out.withColumn("messages", F.when(F.get("messages", 0)["role"] == "system", F.slice("messages", 2, F.greatest(F.size("messages") - 1, F.lit(0)))).otherwise(F.col("messages")))


@recipe
def context_question(df: DataFrame) -> DataFrame:
    lead = F.when(_filled(F.col("context")), F.concat(F.lit("Here gives some useful information:\n"), F.col("context"), F.lit("\n"))).otherwise("")
    return _ask(df, F.concat(lead, F.col("instruction")), F.col("response"))


@recipe
def without_source(df: DataFrame, column: str = "source", value: str = "toxic-dpo-v0.2") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


@recipe
def self_cognition(df: DataFrame, name: tuple[str, str], author: tuple[str, str], query_suffix: str = "", response_prefix: str = "") -> DataFrame:
    """{{NAME}} and {{AUTHOR}} by the row's language (zh first), with optional text around."""
    zh = F.col("tag") == "zh"

    def fill(c: str) -> Column:
        out = F.col(c)
        for mark, (a, b) in (("{{NAME}}", name), ("{{AUTHOR}}", author)):
            out = F.replace(out, F.lit(mark), F.when(zh, a).otherwise(b))
        return out

    return _ask(df, F.concat(fill("query"), F.lit(query_suffix)), F.concat(F.lit(response_prefix), fill("response")))


# -- images, video, sound: the rows only ------------------------------------------------------


@recipe
def fixed_question(df: DataFrame, question: str, answer: str = "response") -> DataFrame:
    return _ask(df, question, F.col(answer))


@recipe
def drawn_question(df: DataFrame, questions: list[str], key: str, answer: str = "response") -> DataFrame:
    return _ask(df, pick(questions, "question", key), F.col(answer))


@recipe
def rooted_paths(df: DataFrame, column: str, root: str, files: DataFrame | None = None) -> DataFrame:
    """Paths under a folder; rows whose file is not listed go."""
    out = df.withColumn(column, F.concat(F.lit(root.rstrip("/") + "/"), F.col(column)))
    return out if files is None else out.join(files.select(F.col("path").alias(column)).distinct(), column, "left_semi")


@recipe
def routed_paths(df: DataFrame, column: str, roots: dict[str, str]) -> DataFrame:
    """The first part of a path decides the folder; unknown parts make the row go."""
    first = F.get(F.split(column, "/"), 0)
    out = F.lit(None).cast("string")
    for part, root in roots.items():
        out = F.when(first == part, F.concat(F.lit(root.rstrip("/") + "/"), F.col(column))).otherwise(out)
    return df.withColumn(column, out).where(F.col(column).isNotNull())


@recipe
def first_of(df: DataFrame, column: str, separator: str = "&&") -> DataFrame:
    return df.withColumn(column, stripped(F.get(F.split(column, separator), 0)))


@recipe
def stripped_caption(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).startswith(prefix), stripped(F.expr(f"substring({column}, {len(prefix) + 1})"))).otherwise(F.col(column)))


@recipe
def spoken_text(df: DataFrame, column: str = "response") -> DataFrame:
    return df.withColumn(column, F.replace(F.col(column), F.lit(" "), F.lit("")))


@recipe
def lettered_options(df: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Options as a text list, the answer as its letter; videos not listed go."""
    letters = F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    out = _ask(df, F.concat(F.col("question"), F.lit("\n"), F.array_join(letters, "\n")), F.char(F.array_position(F.col("options"), F.col("answer")).cast("int") + 64))
    return out if videos is None else out.join(videos.select("video").distinct(), "video", "left_semi")


@recipe
def indexed_choice(df: DataFrame) -> DataFrame:
    return _ask(df, F.col("question"), F.get("choices", F.col("answer")))


@recipe
def first_question(df: DataFrame, columns: list[str], answer: str) -> DataFrame:
    return _ask(df, F.coalesce(*[F.col(c) for c in columns]), F.col(answer)).where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


@recipe
def caption_pair(df: DataFrame, embedding: bool = False) -> DataFrame:
    """The first caption answers, or is the positive of the image."""
    cap = F.get("captions", 0)
    if not embedding:
        return _ask(df, "What is the caption of the image?", cap)
    return df.withColumn("messages", turns(("user", "<image>"))).withColumn("positive_messages", F.array(F.array(F.struct(F.lit("user").alias("role"), cap.alias("content")))))


@recipe
def sampled_negatives(df: DataFrame, key: str, answers: str, n: int = 7, seed: str = "negatives") -> DataFrame:
    """Up to n answers of other rows as negatives, none that is the row's own.

    Distinct answers get places in hash order; row i takes the answers at the 2n places after a hash
    of its key, without its own: an equi-join on the place, no cross join.
    """
    from .sampling import positions

    pool = df.select(F.explode(answers).alias("__a")).distinct()
    total = pool.count()
    if not total:
        return df.withColumn("negatives", F.array().cast("array<string>"))
    placed = positions(pool, draw_order(seed, "__a"), "__a", name="__p")
    start = F.conv(F.substring(draw_order(seed, key), 1, 8), 16, 10).cast("long") % total
    wanted = df.select(key, answers, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(2 * n, total) - 1)), lambda i: (start + i) % total)).alias("__k", "__p"))
    found = wanted.join(placed, "__p").where(~F.array_contains(F.col(answers), F.col("__a")))
    lists = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("__k", "__a"))), 1, n).alias("l"))
    return df.join(lists.select(key, F.col("l.__a").alias("negatives")), key, "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


@recipe
def grounded(df: DataFrame, task: str = "grounding") -> DataFrame:
    """An expression with its box: ask for the box, or for a caption of it."""
    obj = F.struct(F.array(F.col("ref")).alias("ref"), bbox(F.array(F.col("bbox"))).alias("bbox"))
    ask, answer = ("Locate <ref-object> in the image.", "<bbox>") if task == "grounding" else ("Describe <bbox> in the image.", "<ref-object>")
    return df.withColumn("objects", obj).withColumn("messages", turns(("user", f"<image>{ask}"), ("assistant", answer)))


@recipe
def grounded_phrases(df: DataFrame) -> DataFrame:
    """A caption with phrase spans: phrases become object tags; overlapping spans make the row go."""
    from .filters import overlapping

    spans = F.array_sort("spans")
    text = F.aggregate(F.reverse(spans), F.col("caption"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("<ref-object><bbox>"), F.substring(t, s["end"] + 1, F.length(t))))
    refs = F.transform(spans, lambda s: F.substring("caption", s["start"] + 1, s["end"] - s["start"]))
    return _ask(df.where(~overlapping(F.col("spans"))).withColumn("objects", F.struct(refs.alias("ref"), F.transform(spans, lambda s: s["box"]).alias("bbox"))), "<image>Describe the image with boxes.", text)


@recipe
def multilabel(df: DataFrame, names: list[str]) -> DataFrame:
    """0/1 columns -> the list of class numbers."""
    hot = F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(i)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return df.withColumn("label", hot)


@recipe
def asked_with(df: DataFrame, suffix: str, answer: str = "solution") -> DataFrame:
    return df.withColumn("messages", turns(("user", F.concat(F.col("problem"), F.lit(suffix))))).withColumn("solution", F.col(answer))
