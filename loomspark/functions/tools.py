"""Tool calls in model answers: parsing by format, and formatting.

Every parser gives array<struct<name, arguments>> with arguments as text (JSON where the
format holds JSON); formats that find nothing fall back to the Action / Action Input form.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bind import let
from .delimit import by_keywords, stripped

# Keywords of the formats.
REACT_KEYS = ("Action:", "Action Input:", "Observation:")
QWEN_KEYS = ("✿FUNCTION✿:", "✿ARGS✿:", "✿RESULT✿:")
TURN = r"<\|assistant\|>"

JSON = json.JSONDecoder()


def call(name: Column, arguments: Column) -> Column:
    return F.struct(name.alias("name"), arguments.alias("arguments"))


def keyed(text: Column, keys: tuple[str, str, str] = REACT_KEYS) -> Column:
    """Action and Action Input pairs: an input belongs to the action before it that has none yet."""
    parts = F.filter(by_keywords(text, list(keys)), lambda p: p["key"] != "")
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<name:string,arguments:string>>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        opened = F.struct(p["content"].alias("open"), s["done"].alias("done"))
        closed = F.struct(F.lit(None).cast("string").alias("open"), F.concat(s["done"], F.array(call(s["open"], p["content"]))).alias("done"))
        return F.when(s["open"].isNull() & (p["key"] == keys[0]), opened).when(s["open"].isNotNull() & (p["key"] == keys[1]), closed).otherwise(s)

    return F.aggregate(parts, start, step, lambda s: s["done"])


def _json_calls(found: Column, arguments: str = "arguments") -> Column:
    calls = F.transform(found, lambda j: call(F.get_json_object(j, "$.name"), F.get_json_object(j, f"$.{arguments}")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


# Fixed values in the patterns below: the marks of the formats.


def hermes(text: Column) -> Column:
    return _json_calls(F.regexp_extract_all(text, F.lit("(?s)<tool_call>(.+?)</tool_call>"), 1))


def objects(text: str) -> list[tuple[int, int]]:
    """Start and end of every outermost JSON object in a text, in order."""
    found, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = JSON.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = 0
        if end:
            found.append((at, end))
        at = text.find("{", max(end, at + 1))
    return found


def _object_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [t[s:e] for s, e in objects(t)])


def _named_objects(turns: pd.Series) -> pd.Series:
    """The first object of each turn that stands below a line, with that line as its name."""

    def one(turn: str) -> dict | None:
        for s, e in objects(turn):
            above, broken, before = turn[:s].rpartition("\n")
            name = above.rpartition("\n")[2].strip(" `\t\r")
            if broken and not before.strip() and name:
                return {"name": name, "arguments": turn[s:e]}
        return None

    return turns.map(lambda row: None if row is None else [x for x in map(one, row) if x])


object_texts = F.pandas_udf(_object_texts, T.ArrayType(T.StringType()))
named_objects = F.pandas_udf(_named_objects, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])))


def llama(text: Column) -> Column:
    """Objects with a name and parameters."""
    return _json_calls(object_texts(text), "parameters")


def mistral(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?s)\[TOOL_CALLS\]\[(.*?)\]</s>", 1)
    return F.when(body != "", _json_calls(F.split(stripped(body), "\n"))).otherwise(F.array().cast("array<struct<name:string,arguments:string>>"))


def glm4(text: Column) -> Column:
    """A turn of the model is the name on one line and the arguments, an object, below it."""
    return named_objects(F.split(text, TURN))


def _tagged(bodies: Column, name: Callable[[Column], Column], keys: Callable[[Column], Column], values: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    def one(b: Column) -> Column:
        first = lambda k, v: F.map_from_arrays(F.array_distinct(k), F.transform(F.array_distinct(k), lambda x: F.element_at(v, (F.array_position(k, x)).cast("int"))))
        whole = lambda k, v: F.when(fits(b) & (F.size(k) == F.size(v)), call(stripped(name(b)), F.to_json(first(k, v))))
        return let(whole, F.transform(keys(b), stripped), F.transform(values(b), stripped))

    return F.filter(F.transform(bodies, one), lambda c: c.isNotNull())


def glm45(text: Column) -> Column:
    bodies = F.transform(F.regexp_extract_all(text, F.lit("(?s)<tool_call>(.*?)</tool_call>"), 1), stripped)
    return _tagged(bodies, lambda b: F.regexp_extract(b, r"^([^\n<]+)", 1), lambda b: F.regexp_extract_all(b, F.lit("(?s)<arg_key>(.*?)</arg_key>"), 1), lambda b: F.regexp_extract_all(b, F.lit("(?s)<arg_value>(.*?)</arg_value>"), 1), lambda b: b.rlike(r"^[^\n<]"))


def qwen_coder(text: Column, start: str = "tool_call") -> Column:
    bodies = F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{start}>(.*?)</{start}>"), 1), stripped)
    each = r"(?s)<parameter=([^>]+)>\s*(.*?)\s*</parameter>"
    return _tagged(bodies, lambda b: F.regexp_extract(b, r"<function=([^>]+)>", 1), lambda b: F.regexp_extract_all(b, F.lit(each), 1), lambda b: F.regexp_extract_all(b, F.lit(each), 2), lambda b: b.startswith("<function=") & b.endswith("</function>"))


def seed(text: Column) -> Column:
    return qwen_coder(text, "seed:tool_call")


def deepseek(text: Column) -> Column:
    pattern = "(?s)<｜tool▁call▁begin｜>(.*?)<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("a"))
    calls = F.transform(both, lambda x: call(stripped(x["n"]), F.get_json_object(x["a"], "$")))
    return F.filter(calls, lambda c: c["arguments"].isNotNull())


def toolbench(text: Column) -> Column:
    return keyed(text)


def qwen(text: Column) -> Column:
    return keyed(text, QWEN_KEYS)


FORMATS: dict[str, Callable[[Column], Column]] = {"react": keyed, "hermes": hermes, "hunyuan": hermes, "llama": llama, "mistral": mistral, "glm4": glm4, "glm45": glm45, "qwen": qwen, "qwen_coder": qwen_coder, "seed": seed, "deepseek": deepseek, "toolbench": toolbench}


def tool_calls(text: Column, kind: str) -> Column:
    """Calls of a format, or of the Action form where it finds none."""
    found = FORMATS[kind](text)
    return found if kind in ("react", "toolbench") else let(lambda f: F.when(F.size(f) > 0, f).otherwise(keyed(text)), found)


# -- formatting --------------------------------------------------------------------------------


def react_calls(names: Column, arguments: Column, keys: tuple[str, str, str] = REACT_KEYS) -> Column:
    """Calls as text, and the mark after which the observation comes."""
    lines = F.zip_with(names, arguments, lambda n, a: F.concat(F.lit(f"{keys[0]} "), n, F.lit(f"\n{keys[1]} "), a, F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit(keys[2]))


def hermes_calls(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat(F.lit("<tool_call>\n"), c, F.lit("\n</tool_call>"))), "\n")


def hermes_replies(replies: Column) -> Column:
    return F.array_join(F.transform(replies, lambda c: F.concat(F.lit("<tool_response>\n"), c, F.lit("\n</tool_response>"))), "\n")


def wrapped_tool(tool: Column) -> Column:
    """A function description as {"type": "function", "function": ...} unless it is wrapped already; its text stays as it is."""
    return F.when(F.get_json_object(tool, "$.function").isNotNull(), tool).otherwise(F.concat(F.lit('{"type": "function", "function": '), tool, F.lit("}")))


def described_tool(tool: Column) -> Column:
    """name: description of a wrapped or bare function."""
    inner = F.coalesce(F.get_json_object(tool, "$.function"), tool)
    return F.concat(F.get_json_object(inner, "$.name"), F.lit(": "), F.coalesce(F.get_json_object(inner, "$.description"), F.lit("")))


def qwen_calls(names: Column, arguments: Column) -> Column:
    return react_calls(names, arguments, QWEN_KEYS)


def coder_calls(names: Column, arguments: Column) -> Column:
    """Calls with tagged parameters; arguments are JSON objects."""
    one = lambda n, a: F.concat(F.lit("<tool_call>\n<function="), n, F.lit(">\n"), F.array_join(F.transform(F.map_entries(F.from_json(a, "map<string,string>")), lambda e: F.concat(F.lit("<parameter="), e["key"], F.lit(">\n"), e["value"], F.lit("\n</parameter>\n"))), ""), F.lit("</function>\n</tool_call>"))
    return F.array_join(F.zip_with(names, arguments, one), "\n")
