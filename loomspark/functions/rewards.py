"""Rewards of single completions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import algebra
from .bind import let
from .delimit import stripped
from .tokens import SPACE


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def think_answer(text: Column) -> Column:
    """<think>...</think> then <answer>...</answer>, from the first character to the last."""
    return _flag(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"))


def think_action(text: Column) -> Column:
    return _flag(text.rlike(r"(?sm)\A<think>.*?</think>\s*Action:.*?Action Input:.*?$"))


def cosine_length(length: Column, right: Column, most: int = 1000, wrong: tuple[float, float] = (-0.5, 0.0), correct: tuple[float, float] = (1.0, 0.5)) -> Column:
    """(value when short, value when longest) for wrong and correct answers, joined by half a cosine.

    Correct answers run from the longest value to the short one with the ends exchanged, as do
    wrong ones, so a short correct answer earns most.
    """

    def wave(low: float, high: float) -> Column:
        return F.lit(high) - F.lit(high - low) * (1 - F.cos(length * F.pi() / most)) / 2

    return F.when(right, wave(correct[1], correct[0])).otherwise(wave(wrong[1], wrong[0]))


def repetition(text: Column, n: int = 3, worst: float = -1.0) -> Column:
    """worst times the share of repeated n-grams of lower-case words; shorter texts are not punished."""

    def of(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) < n, 0.0).otherwise(let(lambda g: (1 - F.size(F.array_distinct(g)) / F.size(g)) * worst, grams))

    return let(of, F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""))


def overlong(length: Column, most: int, cache: int) -> Column:
    if cache >= most:
        raise ValueError("the cache must be shorter than the limit")
    return F.least(-(length - (most - cache)) / F.lit(float(cache)), F.lit(0.0))


def last_action(text: Column) -> Column:
    """(action, action input) of the last Action block; null input if there is none."""
    body = F.regexp_extract(text, r"(?s)\A(?:.*\n)?\s*Action:\s*(.*?)(?:\n\s*Action Input:.*)?\z", 1)
    given = F.regexp_extract(text, r"(?s).*Action Input:(.*)", 1)
    return F.struct(stripped(body).alias("action"), F.when(F.contains(text, F.lit("Action Input:")), stripped(given)).alias("input"))


def argument_score(got: Column, want: Column) -> Column:
    """F1 over JSON arguments: a key with the right value counts 1, with another value 1/2; texts score 0."""

    def of(g: Column, w: Column) -> Column:
        keys = F.array_intersect(F.map_keys(g), F.map_keys(w))
        hits = F.aggregate(F.transform(keys, lambda k: F.when(F.element_at(g, k).eqNullSafe(F.element_at(w, k)), 1.0).otherwise(0.5)), F.lit(0.0), lambda a, x: a + x)
        both_empty = (F.size(g) == 0) & (F.size(w) == 0)
        # 2pr / (p + r) with p = hits / |g| and r = hits / |w|
        return F.when(g.isNull() | w.isNull(), 0.0).when(both_empty, 1.0).otherwise(2 * hits / (F.size(g) + F.size(w)))

    return let(of, F.from_json(got, "map<string,string>"), F.from_json(want, "map<string,string>"))


def tool_match(got_name: Column, got: Column, want_name: Column, want: Column) -> Column:
    """1 if the action is the wanted one and its arguments match fully."""
    return _flag((got_name == want_name) & (argument_score(got, want) == 1.0))


def boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} without inner braces beyond one level; empty if none."""
    return F.regexp_extract(text, r"(?s).*\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", 1)


def clean_math(text: Column) -> Column:
    """A formula without spaces, \\left, \\right, dollar signs and with plain fractions."""
    out = F.regexp_replace(text, r"\\left|\\right|\\!|\\,|\$|\s", "")
    return F.regexp_replace(F.regexp_replace(out, r"\\dfrac|\\tfrac", r"\\frac"), r"\\text\{([^{}]*)\}", "$1")


def _same_formulas(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(algebra.same(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")


same_formulas = F.pandas_udf(_same_formulas, T.DoubleType())


def same_answer(a: Column, b: Column) -> Column:
    """1.0 where cleaned formulas are equal as texts, or as quotients of polynomials with rational coefficients.

    So 1/2, 0.5 and \\frac{1}{2} agree, and 2(x+1) and 2x+2. Roots and functions are compared as texts.
    """
    x, y = clean_math(a), clean_math(b)
    return F.when(x == y, 1.0).otherwise(F.coalesce(same_formulas(x, y), F.lit(0.0)))


def judged(text: Column) -> Column:
    """The number after "Reward:" in a judge's reply, 0 to 1; null if there is none."""
    return F.regexp_extract(text, r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double")


def judged_mean(texts: Column) -> Column:
    """Mean of the replies that hold a number, 0 if none does."""
    found = F.filter(F.transform(texts, judged), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)).otherwise(0.0)


def process_score(text: Column) -> Column:
    """The number after the first "Reward:", with asterisks removed; 0 where it is none."""
    return F.coalesce(stripped(F.replace(F.get(F.split(text, "Reward:"), 1), F.lit("*"), F.lit(""))).try_cast("double"), F.lit(0.0))


def transcript(messages: Column) -> Column:
    """Role: content lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def thought_choice(thinking: Column, answer: Column) -> Column:
    return F.when(thinking.isNotNull(), F.concat(F.lit("<think>"), thinking, F.lit("</think>\n\n"), answer)).otherwise(answer)
