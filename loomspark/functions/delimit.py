"""Splitting text by keywords or patterns, keeping which one introduced each part."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let


def quoted(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def stripped(text: Column) -> Column:
    """Without white space at both ends, line feeds included."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def by_keywords(text: Column, keys: list[str]) -> Column:
    """[(key, content)]: text cut before every keyword, the longest keyword first; a first part without key may be there."""
    pattern = "|".join(quoted(k) for k in sorted(keys, key=len, reverse=True))
    marks = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    pieces = F.split(text, f"(?:{pattern})")
    out = let(lambda ms, ps: F.transform(ps, lambda p, i: F.struct(F.when(i == 0, "").otherwise(F.get(ms, i - 1)).alias("key"), p.alias("content"))), marks, pieces)
    return F.filter(out, lambda x: (x["key"] != "") | (x["content"] != ""))


def by_patterns(text: Column, patterns: list[str]) -> Column:
    """[(key, content)]: matches carry the pattern that fits them, the text between has an empty key.

    Patterns see line feeds as ordinary characters. The scan is one alternation; which of them fitted
    is decided on the matched text alone.
    """
    whole = "|".join(f"(?:{p})" for p in patterns)
    marks = F.regexp_extract_all(text, F.lit(f"(?s)({whole})"), 1)
    pieces = F.split(text, f"(?s){whole}")
    kind = lambda m: F.coalesce(*[F.when(m.rlike(rf"(?s)\A(?:{p})\z"), F.lit(p)) for p in patterns], F.lit(""))
    pairs = let(lambda ms, ps: F.transform(ps, lambda p, i: F.array(F.struct(F.lit("").alias("key"), p.alias("content")), F.struct(kind(F.get(ms, i)).alias("key"), F.get(ms, i).alias("content")))), marks, pieces)
    return F.filter(F.flatten(pairs), lambda x: x["content"].isNotNull() & (x["content"] != ""))
