"""Broken JSON made whole: what models leave out or write as another language would.

Handles single or missing quotes, missing commas, colons and closing brackets, commas too many, comments, text around the
value, True/False/None, and strings that break off. A text that is JSON already stays as it is.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$")
SKIP = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
BARE = re.compile(r"[^,:{}\[\]\"'\n]+")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: Brackets inside each other at most.
DEPTH = 200


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        self.at = SKIP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0) -> object:
        c = self.peek()
        if depth > DEPTH:
            raise ValueError("too deep")
        if c in ("{", "["):
            return self.several(depth, c)
        return self.string() if c and c in "\"'" else self.bare()

    def several(self, depth: int, open_: str) -> object:
        self.at += 1
        out: dict | list = {} if open_ == "{" else []
        while (c := self.peek()) and c not in "}]":
            before = self.at
            if c in ",:":
                self.at += 1
                continue
            if open_ == "[":
                out.append(self.value(depth + 1))
            else:
                key = self.string() if c in "\"'" else self.bare(text=True)
                if self.peek() == ":":
                    self.at += 1
                    out[str(key)] = self.value(depth + 1) if self.peek() not in ("", ",", "}", "]") else None
                else:
                    out[str(key)] = None
            self.at = max(self.at, before + 1)
        # another bracket ends this value as well, and then its own; a missing one is the end of the text
        self.at += c == ("}" if open_ == "{" else "]")
        return out

    def string(self) -> str:
        quote, out, text = self.text[self.at], [], self.text
        self.at += 1
        while self.at < len(text):
            c = text[self.at]
            self.at += 1
            if c == quote:
                break
            if c != "\\":
                out.append(c)
                continue
            c = text[self.at : self.at + 1]
            self.at += 1
            if c == "u" and re.match(r"[0-9a-fA-F]{4}", text[self.at : self.at + 4]):
                out.append(chr(int(text[self.at : self.at + 4], 16)))
                self.at += 4
            else:
                out.append(ESCAPES.get(c, c))
        return "".join(out)

    def bare(self, text: bool = False) -> object:
        m = BARE.match(self.text, self.at)
        word = m[0].strip() if m else ""
        self.at = m.end() if m else self.at + 1
        if text or not word:
            return word
        if word.lower() in WORDS:
            return WORDS[word.lower()]
        return json.loads(word) if NUMBER.match(word) else word


def repaired(text: str) -> str | None:
    """JSON text, or None where there is no object or list."""
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=None)
    if start is None:
        return None
    try:
        reader = _Reader(text)
        reader.at = start
        return json.dumps(reader.value(), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else repaired(t))


repair_udf = F.pandas_udf(_repaired, T.StringType())


def repair(text: Column) -> Column:
    """The text if it is JSON, else the JSON that it was meant to be, or null; only broken texts need more than one reading."""
    return repair_udf(text)
