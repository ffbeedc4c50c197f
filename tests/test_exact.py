"""Exact results against plain versions: quantiles, in-batch losses, subsequences, formulas, metrics with state."""

import hashlib
import json
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark import plans
from loomspark.functions import algebra, extend, jsonfix, metrics, policy, rewards
from loomspark.sources import catalog

from .compare import DATA


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 400, [-1e308, 1e308, *map(float, range(300))], [random.Random(1).choice([-2.5, 0.0, 7.0, 1e-300, -1e-300, 4e9]) for _ in range(500)], [random.Random(2).gauss(0, 1) for _ in range(700)]])
def test_exact_quantiles(spark, monkeypatch, values):
    monkeypatch.setattr(policy, "LAST", 20)
    monkeypatch.setattr(policy, "BINS", 16)
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
    for q in (0.0, 0.2, 0.77, 1.0):
        assert policy.exact_quantile(df, F.col("x"), q) == pytest.approx(float(np.quantile(np.array(values) / 4, q)) * 4, rel=1e-12, abs=1e-300)
    assert policy.exact_quantile(df.limit(0), F.col("x"), 0.5) is None


def plain_losses(rows, t, margin):
    """Straight from the definition, pair by pair."""
    out = {}
    for b, k, q, d in rows:
        mine = [(x, np.array(y), np.array(z)) for c, x, y, z in rows if c == b]
        q, d = np.array(q), np.array(d)
        pos = q @ d
        terms = [pos]
        for x, y, z in mine:
            if x != k:
                terms += [s for s in (q @ z, q @ y) if margin is None or s <= pos + margin] + [d @ z]
        out[k] = math.log(sum(math.exp((s - max(terms)) / t) for s in terms)) + (max(terms) - pos) / t
    return out


@pytest.mark.parametrize("margin", [None, 0.1])
def test_blocked_losses(spark, monkeypatch, margin):
    for name, n in (("BATCH_BLOCK", 7), ("TILE", 3)):
        monkeypatch.setattr(metrics, name, n)
    r = np.random.default_rng(1)
    rows = [(b, 100 * b + i, r.normal(size=3).tolist(), r.normal(size=3).tolist()) for b, n in ((0, 1), (1, 2), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, k long, q array<double>, d array<double>")
    got = {x["k"]: x["loss"] for x in metrics.infonce_terms(df, "b", "q", "d", "k", 0.2, margin).collect()}
    want = plain_losses(rows, 0.2, margin)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
    stats = {x["b"]: x for x in metrics.infonce_stats(df, "b", "q", "d", "k").collect()}
    s = np.array([x[2] for x in rows[3:]]) @ np.array([x[3] for x in rows[3:]]).T
    off = ~np.eye(40, dtype=bool)
    assert stats[2]["margin"] == pytest.approx(float((s.diagonal() - np.where(off, s, -np.inf).max(1)).mean())) and stats[2]["mean_neg"] == pytest.approx(s[off].mean())
    assert stats[0]["mean_neg"] is None and stats[0]["loss"] == pytest.approx(0.0, abs=1e-12)
    monkeypatch.setattr(metrics, "IN_BATCH", 10)
    with pytest.raises(Exception, match="more than 10 pairs"):
        metrics.in_batches(df, "b", "q", "d", "k").collect()


def test_large_batch_has_no_row_for_each_pair(spark):
    """20,000 pairs of one batch: blocks, not 400 million rows."""
    df = spark.range(20_000).select(F.lit(0).alias("b"), F.col("id").alias("k"), F.array(F.sin("id"), F.cos("id")).alias("q"), F.array(F.sin("id"), F.cos("id")).alias("d"))
    n = metrics._blocks(df, "b", "q", "d", "k").count()
    assert n == 2 * 20_000 * 5
    out = metrics.infonce_stats(df, "b", "q", "d", "k").first()
    assert out["mean_pos"] == pytest.approx(1.0) and out["loss"] > 5


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequences():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert metrics.common_length(a, b) == table_length(a, b)


@pytest.mark.parametrize("bits", [1, 7, 64])
def test_common_subsequences_over_several_numbers(monkeypatch, bits):
    monkeypatch.setattr(metrics, "BITS", bits)
    r = random.Random(bits)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert metrics.common_length(a, b) == table_length(a, b)


def test_common_subsequences_of_long_texts_take_little_memory():
    """20,000 different words: no number of 20,000 bits for each of them."""
    a = [str(i) for i in range(20_000)]
    tracemalloc.start()
    try:
        assert metrics.common_length(a, a[5000:]) == 15_000
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_rouge_and_bleu_of_whole_turns(spark):
    """The query over all turns against plain versions."""
    turns = {(x["conv_id"], x["turn"]): x["text"].split() for x in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = plans.QUERIES["rouge_l_bleu"](spark, DATA).collect()
    assert len(got) == sum((c, t + 1) in turns for c, t in turns)
    for x in got:
        a, b = turns[x["conv_id"], x["turn"]], turns[x["conv_id"], x["turn"] + 1]
        assert x["rouge_l"] == pytest.approx(2 * table_length(a, b) / (len(a) + len(b)) if a and b else 0.0)
        logs = []
        for k in range(1, 5):
            grams = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in (a, b)]
            hits, smooth = sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0])), int(k > 1)
            logs.append(math.log(max((hits + smooth) / max(len(grams[0]) + smooth, 1), 1e-12)) / 4)
        assert x["bleu"] == pytest.approx(math.exp(sum(logs) + min(0.0, 1 - len(b) / max(len(a), 1))) if a else 0.0)


def test_subsets_hold_every_row(spark):
    """Each row of each subset, whole digests and copies counted, against a plain version."""
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    want = Counter()
    for x in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for part, said in (("default", x["source"]), ("a", x["lang"]), ("b", x["lang"])):
            want[part, md5(f"user:{said}|assistant:{md5(x['text'] or '')}")] += 1
    got = plans.QUERIES["catalog_subsets"](spark, DATA).collect()
    assert {(x["part"], x["digest"]): x["n"] for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("a", "b", "equal"), [
    ("1/2", "0.5", True), (r"\frac{1}{2}", "0.50", True), (r"\dfrac12", ".5", True), ("2(x+1)", "2x+2", True), ("(x+1)^2", "x^2+2x+1", True), (r"\frac{x^2-1}{x-1}", "x+1", True), ("50%", "1/2", True),
    ("-3^2", "-9", True), ("(-3)^2", "9", True), ("2^{-1}", r"\frac{1}{2}", True), (r"3\cdot x\times y", "3yx", True), ("1/2x", "x/2", True), ("6/-2", "-3", True), ("x", "y", False), ("1/3", "0.333", False), ("1/0", "1/0", True), ("1/0", "2/0", False),
    ("x^100", "x^100", True), ("x^100", "x^{100}", False), (r"\sqrt{2}", r"\sqrt{2}", True), (r"\sqrt{2}", "1.41421356", False), ("__import__('os')", "0", False), ("(" * 5000, "1", False), ("9" * 600, "1", False), ("", "", True), ("", "0", False), ("2+", "2", False),
])
def test_equal_formulas(a, b, equal):
    assert algebra.same(a, b) is equal and algebra.same(b, a) is equal


def test_equal_answers(spark):
    rows = [(r"\left(x+1\right)^2", "$x^2 + 2x + 1$"), ("7", "8"), (None, "1"), ("a, b", "a,b")]
    got = spark.createDataFrame(rows, "a string, b string").select(rewards.same_answer(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in got] == [1.0, 0.0, 0.0, 1.0]


def test_metric_states_merge(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("t"), F.col("id") % 700).alias("t")).repartition(40)
    assert extend.Largest("id", 4).over(df) == [4999, 4998, 4997, 4996] and extend.Largest("id", 4).over(df.limit(0)) == []
    assert extend.Distinct("t").over(df) == 700.0
    assert abs(extend.Distinct("t", 128).over(df) / 700 - 1) < 0.3
    assert extend.Mean("id").over(df) == 2499.5


@pytest.mark.parametrize(("text", "value"), [
    ('{"a": 1}', {"a": 1}), ("{'a': 'it\\'s', \"b\": [1, 2,],}", {"a": "it's", "b": [1, 2]}), ("{a: true, b: None, c: NaN}", {"a": True, "b": None, "c": None}), ('{"a": "b', {"a": "b"}), ('[1 2, "x"', ["1 2", "x"]), ('say {"a": {"b": [1, {"c": 2}}', {"a": {"b": [1, {"c": 2}]}}),
    ('{"a" "b"}', {"a": None, "b": None}), ('{"a": , "b": -1.5e3}', {"a": None, "b": -1500.0}), ('{"a": "\\u00e9\\n" /* no */}', {"a": "é\n"}), ("none at all", None), ("", None), ("[" * 3000, None), ("{" + ":" * 2000, {}),
])
def test_repaired_json(text, value):
    got = jsonfix.repaired(text)
    assert (None if got is None else json.loads(got)) == value


def test_source_columns_equal_source_strings(spark):
    texts = ["hf::a/b:x/y#20", "MS::a#5", "a/b.jsonl", "c: all ", "x::y", "kept#1:2", "a#1#2", "::", "a::b::c:d:e", "", " hf::x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", catalog.parsed(F.col("t"), lambda t: t == "kept#1:2").alias("s")).collect()
    for t, s in got:
        want = catalog.Source.parse(t, lambda x: x == "kept#1:2")
        assert (s["hub"], s["name"], tuple(s["subsets"]), s["count"]) == (want.hub, want.name, want.subsets, want.count)
