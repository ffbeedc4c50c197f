"""Bring heterogeneous chat rows to the standard shape; expressions only, no Python on rows.

Schema decisions (which columns exist, which format it is) are made once on the driver.
"""

from __future__ import annotations

import ast
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.bind import let


def message(role: str | Column, content: Column, loss: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"), (F.lit(None).cast("double") if loss is None else loss.cast("double")).alias("loss"))


# -- columns --------------------------------------------------------------------------------


def safe_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename without case; where several columns would take one name, none of them does."""
    lower = {k.lower(): v for k, v in names.items()}
    wanted = {c: lower[c.lower()] for c in df.columns if c.lower() in lower}
    hits = Counter(wanted.values())
    taken = set(df.columns)
    moves = {c: t for c, t in wanted.items() if hits[t] == 1 and c != t and (t not in taken)}
    return df.withColumnsRenamed(moves)


def media_names(df: DataFrame) -> dict[str, str]:
    """image -> images and so on, for every prefix."""
    return {f"{p}{m[:-1]}": f"{p}{m}" for p in S.PREFIXES for m in S.MEDIA}


def prune(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only standard columns and those asked for."""
    return df.select([c for c in df.columns if c in S.STANDARD or c in keep])


def strip_prefix(df: DataFrame, prefixes: tuple[str, ...] = ("__@", "__#")) -> DataFrame:
    """Protected columns get their names back unless the name is in use."""
    for c in df.columns:
        for p in prefixes:
            if c.startswith(p):
                df = df.drop(c) if c[len(p) :] in df.columns else df.withColumnRenamed(c, c[len(p) :])
    return df


def standard_types(df: DataFrame) -> DataFrame:
    """Cast every standard column to its fixed type."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in S.TYPES.items() if t is not None and c in df.columns})


def media_list(col: Column, kind: T.DataType) -> Column:
    """A path, a list of paths, or structs with bytes and path -> array<struct<bytes, path>>."""
    if isinstance(kind, T.StringType):
        col, kind = F.when(col.isNotNull(), F.array(col)), T.ArrayType(kind)
    if isinstance(kind, T.StructType):
        col, kind = F.when(col.isNotNull(), F.array(col)), T.ArrayType(kind)
    if isinstance(kind.elementType, T.StringType):
        return F.transform(col, lambda x: F.struct(F.lit(None).cast("binary").alias("bytes"), x.alias("path")))
    names = kind.elementType.names
    return F.transform(col, lambda x: F.struct((x["bytes"] if "bytes" in names else F.lit(None)).cast("binary").alias("bytes"), (x["path"] if "path" in names else F.lit(None)).cast("string").alias("path")))


def prune_messages(col: Column, fields: list[str]) -> Column:
    """Messages with role, content and loss only."""
    return F.transform(col, lambda m: message(m["role"], m["content"], m["loss"] if "loss" in fields else None))


def bbox(col: Column) -> Column:
    """Two-point boxes ordered so that the first point is the lesser one; pairs stay."""
    return F.transform(col, lambda b: F.when(F.size(b) == 4, F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))).otherwise(b))


def objects(ref: Column, boxes: Column, bbox_type: Column | None = None, image_id: Column | None = None) -> Column:
    return F.struct(ref.alias("ref"), bbox(boxes).alias("bbox"), (F.lit(None) if bbox_type is None else bbox_type).cast("string").alias("bbox_type"), (F.lit(None) if image_id is None else image_id).cast("array<bigint>").alias("image_id"))


# -- formats --------------------------------------------------------------------------------


def history_messages(history: Column, system: Column | None = None) -> Column:
    """[[query, response], ...] -> messages; null queries and responses are left out."""
    pairs = F.flatten(F.transform(history, lambda p: F.filter(F.array(message("user", p[0]), message("assistant", p[1])), lambda m: m["content"].isNotNull())))
    if system is None:
        return pairs
    return F.when(system.isNotNull(), F.concat(F.array(message("system", system)), pairs)).otherwise(pairs)


def messages_history(messages: Column) -> Column:
    """Messages without system -> [[query, response], ...]; an odd last query has a null response."""

    def of(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size(m)))
        return F.transform(starts, lambda i: F.array(F.get(m, i)["content"], F.get(m, i + 1)["content"]))

    return let(of, F.filter(messages, lambda x: x["role"] != "system"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def literal_pairs(text: pd.Series) -> pd.Series:
    """Python-literal history strings, which no JSON reader takes; anything unreadable is null."""

    def read(s):
        try:
            return None if s is None else [[None if v is None else str(v) for v in pair] for pair in ast.literal_eval(s)]
        except (ValueError, SyntaxError, TypeError):
            return None

    return text.map(read)


def _column(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def from_response(df: DataFrame) -> DataFrame:
    """query / response / history / system columns under any of their names -> messages."""
    names = {n: t for t, ns in (("system", S.SYSTEM_NAMES), ("query", S.QUERY_NAMES), ("response", S.RESPONSE_NAMES)) for n in ns}
    df = safe_rename(df, names)
    response = _column(df, "response")
    if response is not None and isinstance(df.schema["response"].dataType, T.ArrayType):
        response = F.get(response, 0)
    null = F.lit(None).cast("string")
    last = F.array(F.array((null if "query" not in df.columns else F.col("query").cast("string")), (null if response is None else response.cast("string"))))
    if "history" in df.columns:
        past = F.col("history")
        if isinstance(df.schema["history"].dataType, T.StringType):
            past = F.coalesce(F.from_json(past, "array<array<string>>"), literal_pairs(past))
        last = F.concat(F.coalesce(past.cast("array<array<string>>"), F.array().cast("array<array<string>>")), last)
    out = df.withColumn("messages", history_messages(last, _column(df, "system")))
    return out.drop(*[c for c in ("query", "response", "history", "system") if c in df.columns])


def from_alpaca(df: DataFrame) -> DataFrame:
    """instruction and input make the query; output is the response."""
    lower = {c.lower(): c for c in df.columns}
    i, x = F.col(lower["instruction"]), F.col(lower["input"])
    query = F.when((F.coalesce(i, F.lit("")) != "") & (F.coalesce(x, F.lit("")) != ""), F.concat(i, F.lit("\n"), x)).when(F.coalesce(i, F.lit("")) != "", i).otherwise(x)
    out = df.withColumn("__q", query).drop(lower["instruction"], lower["input"])
    if "output" in lower:
        out = out.withColumnRenamed(lower["output"], "response") if "response" not in lower else out.withColumn("response", F.coalesce(F.col(lower["output"]), F.col(lower["response"]))).drop(lower["output"])
    return from_response(out.withColumnRenamed("__q", "query"))


def _first(m: Column, fields: list[str], names: tuple[str, ...]) -> Column:
    have = [m[n] for n in names if n in fields]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def role_of(role: Column, users=S.USER_ROLES, assistants=S.ASSISTANT_ROLES) -> Column:
    plain = F.replace(role, F.lit("-"), F.lit("_"))
    return F.when(role.isin(*users), "user").when(role.isin(*assistants), "assistant").when(plain.isin(*S.CALL_ROLES), "tool_call").when(plain.isin(*S.REPLY_ROLES), "tool_response").otherwise(role)


def messages_of(col: Column, fields: list[str], system: Column | None = None, users=S.USER_ROLES, assistants=S.ASSISTANT_ROLES, system_role: str = "system") -> Column:
    """Messages with role/from and content/value keys, or human/assistant pairs, to the standard shape."""
    if "role" in fields or "from" in fields or "content" in fields:
        flat = F.transform(col, lambda m: message(_first(m, fields, ("role", "from")), _first(m, fields, ("content", "value")), m["loss"] if "loss" in fields else None))
        head = F.get(flat, 0)["role"] == system_role
        rest = F.transform(flat, lambda m: message(F.when(m["role"] == system_role, "system").otherwise(role_of(m["role"], users, assistants)), m["content"], m["loss"]))
        if system is None:
            return rest
        return F.when(head | system.isNull(), rest).otherwise(F.concat(F.array(message("system", system)), rest))
    pairs = F.flatten(F.transform(col, lambda m: F.array(message("user", _first(m, fields, users)), message("assistant", _first(m, fields, assistants)))))
    return pairs if system is None else F.when(system.isNotNull(), F.concat(F.array(message("system", system)), pairs)).otherwise(pairs)


def from_messages(df: DataFrame, inner: str | None = None, **roles) -> DataFrame:
    """messages / conversation(s) columns, as arrays of structs or as JSON text."""
    df = safe_rename(df, {n: "messages" for n in S.MESSAGES_NAMES} | {n: "system" for n in S.SYSTEM_NAMES})
    system = _column(df, "system")
    for name in ("messages", "rejected_messages"):
        if name not in df.columns:
            continue
        kind, col = df.schema[name].dataType, F.col(name)
        if inner and name == "messages":
            col, kind = col[inner], kind[inner].dataType
        if isinstance(kind, T.StringType):
            kind = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("role", "from", "content", "value")]))
            col = F.from_json(col, kind)
        df = df.withColumn(name, messages_of(col, kind.elementType.names, system if name == "messages" else None, **roles))
    return df.drop("system") if system is not None else df


def kind_of(columns: list[str]) -> str:
    """The format of a table, from its columns: messages, alpaca or response."""
    lower = {c.lower() for c in columns}
    if lower & set(S.MESSAGES_NAMES):
        return "messages"
    return "alpaca" if {"instruction", "input"} <= lower else "response"


def normalize(df: DataFrame, columns: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Any recognised layout -> standard columns; bad rows go (see filters.valid_messages)."""
    from .filters import drop_bad

    if columns:
        df = safe_rename(df, columns)
    out = {"messages": from_messages, "alpaca": from_alpaca, "response": from_response}[kind_of(df.columns)](df)
    out = safe_rename(out, media_names(out))
    for p in S.PREFIXES:
        if f"{p}images" in out.columns:
            out = out.withColumn(f"{p}images", media_list(F.col(f"{p}images"), out.schema[f"{p}images"].dataType))
        for m in ("videos", "audios"):
            if f"{p}{m}" in out.columns and isinstance(out.schema[f"{p}{m}"].dataType, T.StringType):
                out = out.withColumn(f"{p}{m}", F.when(F.col(f"{p}{m}").isNotNull(), F.array(f"{p}{m}")))
    return prune(standard_types(drop_bad(out)), keep)


def to_class(df: DataFrame, label: str = "label") -> DataFrame:
    """Integer class labels; rows whose label is no integer go."""
    return df.withColumn(label, F.expr(f"try_cast({label} as int)")).where(F.col(label).isNotNull())


def generation_prompt(query: Column, prompt: str) -> Column:
    return F.replace(F.lit(prompt), F.lit("{{QUERY}}"), query)


def class_prompt(task: str, names: list[str], sentences: list[Column], label: Column) -> tuple[Column, Column]:
    """Classification as generation: the prompt, and the name of the label."""
    body = [F.lit(f"Task: {task}\n")] + ([x for i, s in enumerate(sentences) for x in (F.lit(f"Sentence{i + 1}: "), s, F.lit("\n"))] if len(sentences) > 1 else [F.lit("Sentence: "), sentences[0], F.lit("\n")])
    body.append(F.lit(f"Category: {', '.join(names)}\nOutput:"))
    return F.concat(*body), F.element_at(F.array(*[F.lit(n) for n in names]), label.cast("int") + 1)


def pick(values: list[str], seed: str, *keys: str) -> Column:
    """A choice among values that depends on the row's keys only."""
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long"), F.lit(len(values)))
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def grounding_prompt(task: str, prompts: dict[str, dict[str, list[str]]], key: str, english: float = 0.8) -> Column:
    """A prompt of a task ("grounding" or "caption") by hash of the key: English for a share of rows, else Chinese."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit("language:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(at < english, pick(prompts[task]["en"], task, key)).otherwise(pick(prompts[task]["zh"], task, key))


def parts_text(parts: Column) -> tuple[Column, Column]:
    """Content parts (type, text, url) -> text with media tags, and the urls of the media."""
    text = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<"), F.regexp_replace(p["type"], "_url$", ""), F.lit(">")))), "")
    return text, F.transform(F.filter(parts, lambda p: p["type"] != "text"), lambda p: p["url"])


def rejected_from_response(messages: Column, rejected: Column) -> Column:
    """The conversation up to its last user turn, answered by the rejected response."""
    at = F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()))
    return F.when(rejected.isNotNull(), F.concat(F.slice(messages, 1, at + 1), F.array(message("assistant", rejected))))


def preference_bundle(df: DataFrame) -> DataFrame:
    """chosen and rejected structs; the rejected side takes what it lacks from the chosen one."""
    names = [c for c in df.columns if c in ("messages", "images", "videos", "audios", "tools", "objects")]
    chosen = F.struct(*[F.col(n) for n in names]).alias("chosen")
    rejected = F.struct(*[(F.coalesce(F.col(f"rejected_{n}"), F.col(n)) if f"rejected_{n}" in df.columns else F.col(n)).alias(n) for n in names]).alias("rejected")
    rest = [c for c in df.columns if c not in names and not (c.startswith("rejected_") and c[9:] in names)]
    return df.select(*rest, chosen, rejected)
