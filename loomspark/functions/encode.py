"""Encoded samples: token ids, labels, loss scales and lengths, for every task.

The tokenizer is a parameter: a function from a text column to array<int>. The default is the
deterministic stand-in of tokens.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lossmask, render, tokens
from .bind import let

Tokenizer = Callable[[Column], Column]
TASKS = ("causal_lm", "rlhf", "kto", "embedding", "reranker", "generative_reranker", "seq_cls")
TRUNCATIONS = ("raise", "left", "right", "split")


def encoded(messages: Column, template: render.Template = render.CHATML, strategy: str = "default", scale: str | None = None, tokenizer: Tokenizer = tokens.token_ids, training: bool = True) -> Column:
    """struct<input_ids, labels, loss_scale, length> of a conversation."""
    system, rest = render.system_of(messages)
    pairs = render.standardised(render.merged_turns(rest))
    found = let(lambda p, s: F.struct(render.last_user(p).alias("late"), render.parts(p, s, template, training).alias("parts")), pairs, system)
    return let(lambda f: _encoded(f["parts"], f["late"], strategy, scale, tokenizer), found)


def _encoded(parts: Column, late: Column, strategy: str, scale: str | None, tokenizer: Tokenizer) -> Column:
    def one(p: Column) -> Column:
        base = lossmask.base_scale(p["kind"], p["round"] * 2, F.lit(None).cast("double"), late, strategy)
        whole = F.array(F.struct(p["text"].alias("text"), base.alias("weight")))
        if scale:
            cut = lossmask.weighted(p["text"], scale)
            whole = F.when((p["kind"] == "response") & (base > 0), cut).otherwise(whole)
        return F.transform(whole, lambda w: F.struct(tokenizer(w["text"]).alias("t"), w["weight"].alias("w")))

    def sample(pieces: Column) -> Column:
        ids = F.flatten(F.transform(pieces, lambda x: x["t"]))
        scales = F.flatten(F.transform(pieces, lambda x: F.transform(x["t"], lambda _: x["w"])))
        return let(lambda i, s: F.struct(i.alias("input_ids"), tokens.masked_labels(i, s).alias("labels"), s.alias("loss_scale"), F.size(i).alias("length")), ids, scales)

    return let(sample, F.flatten(F.transform(parts, one)))


def fitted(df: DataFrame, most: int, how: str = "raise") -> DataFrame:
    """Rows cut to most tokens: too long rows go (raise), lose a side, or become several rows (split)."""
    if how not in TRUNCATIONS:
        raise ValueError(f"unknown truncation {how}")
    if how == "raise":
        return df.where(F.size("input_ids") <= most)
    if how == "split":
        from ..operators.expand import chunks

        cut = chunks(df.withColumn("loss_scale", F.col("loss_scale")), "input_ids", most, "labels")
        scales = F.slice("loss_scale", F.col("chunk") * most + 1, F.lit(most))
        return cut.withColumn("loss_scale", scales).withColumn("length", F.size("input_ids"))
    out = df
    for c in ("labels", "loss_scale", "input_ids"):
        out = out.withColumn(c, tokens.truncated(F.col(c), F.col("input_ids"), most, how))
    return out.withColumn("labels", tokens.first_masked(F.col("labels"))).withColumn("length", F.size("input_ids"))


def task_rows(df: DataFrame, task: str, **how) -> DataFrame:
    """Encoded columns of a task, prefixed by the side they belong to.

    causal_lm, seq_cls: plain. rlhf: chosen_ and rejected_. kto: completion_ and, from shifted
    pairs, kl_. embedding: anchor_, positive_, negatives (array). reranker: query with each document.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    enc = lambda c: encoded(c, **how)
    spread = lambda d, name, prefix="": d.withColumns({f"{prefix}{f}": F.col(name)[f] for f in ("input_ids", "labels", "loss_scale", "length")}).drop(name)
    if task in ("causal_lm", "seq_cls"):
        out = df.withColumn("__e", enc(F.col("messages") if task == "causal_lm" else render.without_tail(F.col("messages"))))
        return spread(out, "__e")
    if task == "rlhf":
        out = spread(df.withColumn("__c", enc(F.col("messages"))), "__c", "chosen_")
        return spread(out.withColumn("__r", enc(F.col("rejected_messages"))), "__r", "rejected_")
    if task == "kto":
        out = spread(df.withColumn("__c", enc(F.col("messages"))), "__c", "completion_")
        return spread(out.withColumn("__k", enc(F.col("kl_messages"))), "__k", "kl_")
    sides = lambda c: F.transform(c, lambda m: enc(m))
    if task == "embedding":
        out = spread(df.withColumn("__a", enc(F.col("messages"))), "__a", "anchor_")
        out = spread(out.withColumn("__p", enc(F.get("positive_messages", 0))), "__p", "positive_")
        return out.withColumn("negatives", sides(F.col("negative_messages"))) if "negative_messages" in df.columns else out
    both = F.concat(F.transform("positive_messages", lambda m: F.struct(m.alias("m"), F.lit(1).alias("label"))), F.transform("negative_messages", lambda m: F.struct(m.alias("m"), F.lit(0).alias("label"))))
    rows = df.withColumn("__d", F.explode(both)).withColumn("label", F.col("__d.label"))
    joined = F.concat(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.transform("__d.m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return spread(rows.withColumn("__e", enc(joined)).drop("__d"), "__e")


def stacked(df: DataFrame, batch: str, key: str, prefixes: tuple[str, str] = ("chosen_", "rejected_"), fields: tuple[str, ...] = ("input_ids", "labels")) -> DataFrame:
    """Two sides as rows of one batch, the first side first, padded together."""
    both = None
    for i, p in enumerate(prefixes):
        side = df.select(batch, key, F.lit(i).alias("side"), *[F.col(p + f).alias(f) for f in fields])
        both = side if both is None else both.unionByName(side)
    return tokens.collate(both, batch)


def sampled_documents(df: DataFrame, key: str, negatives: int = 7, seed: str = "rerank") -> DataFrame:
    """Of each query's documents (positives and negatives as arrays): the first positive and some negatives by hash."""
    order = lambda c: F.array_sort(F.transform(c, lambda d: F.struct(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"), F.to_json(F.array(d)))).alias("h"), d.alias("d"))))
    return df.withColumn("positive_messages", F.slice(order(F.col("positive_messages"))["d"], 1, 1)).withColumn("negative_messages", F.slice(order(F.col("negative_messages"))["d"], 1, negatives))


def attached(df: DataFrame, side: str = "positive") -> DataFrame:
    """Each positive (or negative) list after the conversation it belongs to."""
    c = f"{side}_messages"
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return df.withColumn(c, F.transform(c, lambda x: F.concat(plain, x)))


def with_token_answers(messages: Column, answers: Column) -> Column:
    """Answers by token ids, matched from the last turn backwards: (role, content, ids) with null ids where none is given."""
    back = F.reverse(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull()))
    return let(lambda b, given: F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["role"] == "assistant", F.get(given, (F.array_position(b, i) - 1).cast("int"))).alias("ids"))), back, F.reverse(answers))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns of one side under their plain names."""
    return df.select(*[F.col(c).alias(c[len(prefix) :]) for c in df.columns if c.startswith(prefix)])


def json_or(text: Column, key: str, default: Column) -> Column:
    """A JSON field, or a default where the text is no JSON or lacks it."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), default)
