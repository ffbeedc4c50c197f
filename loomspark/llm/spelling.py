"""Spelling variants: one-edit pairs by merging the light subtrees of a trie into its heavy paths.

The trie of all words is a table of nodes (prefixes) and of the letters that follow each. Of a
node's letters the one with the most words below it is heavy. Every word hangs below at most
log2(words) light edges, and only there is it merged with the rest of its node, in three copies:
with the light letter replaced by the heavy one, with it skipped, and with the heavy letter put
before it. Two words are one edit apart just if terminals coincide:

- replaced copies of one node that are equal, and the word on the heavy path that they equal,
  differ in this one letter: a class in which all are near each other, of one word for each
  letter at most;
- a skipped or prolonged copy that equals a word is one letter away from it.

Counts of nodes are pre-aggregated; nodes of the first two letters, of which there are no more than
the alphabet allows, are broadcast, all else is joined on strings that few words share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, files_for, materialise

#: Code points of a word at least, occurrences at least, and times its own count that a form's count has.
LEAST, OFTEN, TIMES = 5, 3, 2
#: One in so many of a document's words loses a letter.
DAMAGED = 97
#: A letter in UTF-8: A-Z, a-z, U+00C0 to U+00FF. Shorter runs cannot become words.
RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf]){%d,}" % LEAST)
#: Letters of a prefix whose node is broadcast: (26 + 64) ** 2 + 91 nodes at most.
SHORT = 2
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def damaged(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words_of(doc_id: int | None, text: str | None) -> Counter[str]:
    """Words of LEAST code points or more after damage, with their occurrences."""
    out: Counter[str] = Counter()
    name = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for raw, n in Counter(RUNS.findall((text or "").encode("utf-8", "surrogatepass").lower())).items():  # bytes: only A-Z change
        h = zlib.crc32(raw, name)
        word = raw.decode()
        if h % DAMAGED == 0:
            word = damaged(word, h)
        if len(word) >= LEAST:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of all words with OFTEN occurrences or more; counted in each task before the shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for pdf in batches:
            for i, t in zip(pdf["doc_id"].array, pdf["t"], strict=True):
                held.update(words_of(None if pd.isna(i) else int(i), t))
            if len(held) > HELD:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _cut(word: Column, at: Column, skip: int, put: Column | None = None) -> Column:
    """word with skip letters taken out at a place, and another put in."""
    before, after = F.substr(word, F.lit(1), at), F.substr(word, at + 1 + skip)
    return F.concat(before, put, after) if put is not None else F.concat(before, after)


def light_edges(words: DataFrame, files: int) -> DataFrame:
    """word, n, at, letter ('' where the word ends), heavy: the light edges on every word's path.

    Only nodes with several edges have light ones.
    """
    word = F.col("word")
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length(word))).alias("at"))
    steps = steps.select("word", "n", "at", F.substr(word, F.lit(1), F.col("at")).alias("node"), F.substr(word, F.col("at") + 1, F.lit(1)).alias("letter"))
    edges = steps.groupBy("node", "letter").agg(F.count("*").alias("below"))
    heavy = F.max(F.when(F.col("letter") != "", F.struct("below", "letter")))["letter"].alias("heavy")
    nodes = materialise(edges.groupBy("node").agg(heavy, F.count("*").alias("edges")).where("edges > 1").select("node", "heavy"), files)
    long_, wide = F.char_length("node"), steps.drop("node", "letter")
    near = steps.where(F.col("at") <= SHORT).join(F.broadcast(nodes.where(long_ <= SHORT)), "node")
    far = steps.where(F.col("at") > SHORT).join(nodes.where(long_ > SHORT), "node")
    return near.unionByName(far).where("letter != heavy").select(*wide.columns, "letter", "heavy")


def near_words(words: DataFrame, files: int) -> DataFrame:
    """word, n_near and the best near word (struct of -n and word) of every word that has one."""
    word, at = F.col("word"), F.col("at")
    light = materialise(light_edges(words, files), files)
    mine = F.struct((-F.col("n")).alias("less"), "word").alias("mine")

    replaced = light.where("letter != ''").select("at", _cut(word, at, 1, F.col("heavy")).alias("copy"), mine)
    ends = words.select(F.col("word").alias("copy"), F.struct((-F.col("n")).alias("less"), "word").alias("mine"))
    heavy = replaced.select("at", "copy").distinct().join(ends, "copy").select("at", "copy", "mine")
    # one word for each letter at most, so the lists are bounded by the alphabet
    classes = replaced.unionByName(heavy).groupBy("at", "copy").agg(F.sort_array(F.collect_list("mine")).alias("all")).where(F.size("all") > 1)
    one = classes.select(F.posexplode("all").alias("i", "mine"), "all")
    best = F.when(F.col("i") == 0, F.col("all")[1]).otherwise(F.col("all")[0])
    one = one.select("mine.word", (F.size("all") - 1).alias("near"), best.alias("best"))

    skipped = light.where("letter != ''").select(_cut(word, at, 1).alias("copy"), mine)
    longer = light.select(_cut(word, at, 0, F.col("heavy")).alias("copy"), mine)
    # a pair may coincide at several nodes: (longer, shorter) stands once
    below = skipped.join(ends.withColumnRenamed("mine", "end"), "copy").select(F.col("mine").alias("long"), F.col("end").alias("short"))
    above = longer.join(ends.withColumnRenamed("mine", "end"), "copy").select(F.col("end").alias("long"), F.col("mine").alias("short"))
    pairs = below.unionByName(above).distinct()
    two = pairs.select(F.col("long.word").alias("word"), F.lit(1).alias("near"), F.col("short").alias("best"))
    two = two.unionByName(pairs.select(F.col("short.word").alias("word"), F.lit(1).alias("near"), F.col("long").alias("best")))

    out = materialise(one.unionByName(two).groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best")), files)
    discard(light)
    return out


def roots(forms: DataFrame, files: int) -> DataFrame:
    """word, root of every word with a form; forms: word, form (of larger count, so there are no rings)."""
    now = materialise(forms.select("word", F.col("form").alias("root")), files)
    while True:  # the way to the root halves each time
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), files)
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest n, ties to the
    smallest, if that n is TIMES its own or more. A null text has no words; a null doc_id counts as an
    empty one in the checksum that damages words. Repeated rows count each time. An empty table gives an
    empty result; other columns are not read.
    """
    files = files_for(docs)
    words = materialise(vocabulary(docs, text), files)
    near = near_words(words, files)
    best = -F.col("best.less")
    form = F.when(best >= TIMES * F.col("n"), F.col("best.word"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), best).alias("form_n"))
    out = materialise(out, files)
    discard(near)
    found = roots(out.where("form is not null").select("word", "form"), files)
    return out.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
