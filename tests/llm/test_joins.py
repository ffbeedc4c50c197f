"""Joins on sets, vectors and words against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import balltree, clusters, prefixjoin, queries, spelling

from ..compare import DATA, same
from .test_corpus import ODD, WORD, docs_of, prose


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


# -- 11: n-gram Jaccard join -------------------------------------------------------------------------------------


def shingles(text, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_join(texts, ids, percent=90):
    sets = [shingles(t) for t in texts]
    known = [i for i, x in enumerate(ids) if x is not None and sets[i]]
    pairs = [(i, j) for i, j in itertools.combinations(known, 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = roots(len(texts), pairs)
    least = {}
    for i in known:
        least[of[i]] = min(least.get(of[i], ids[i]), ids[i])
    return [(x, len(s), None if x is None else least.get(r, x) if s else x) for x, s, r in zip(ids, sets, of, strict=True)]


def edited(r, base, n, low, high):
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(low, high)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 9999)}"
        yield " ".join(w)


def test_tree_links_equal_brute_force():
    r = random.Random(1)
    for _ in range(150):
        base = [r.sample(range(1000), r.randint(1, 60)) for _ in range(3)]
        sets = []
        for _ in range(r.randint(1, 30)):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 4)):
                s ^= {r.choice(sorted(s) or [0]) if r.random() < 0.5 else r.randint(0, 1000)}
            sets.append(s)
        sizes = np.array([len(s) + r.randint(0, 2) for s in sets])
        percent = r.choice([60, 80, 90, 100])
        both = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.combinations(range(len(sets)), 2)}
        of = roots(len(sets), [k for k, n in both.items() if n and 100 * n >= percent * (sizes[k[0]] + sizes[k[1]] - n)])
        found, got = prefixjoin.tree_links([np.array(sorted(s), np.int64) for s in sets], sizes, np.arange(len(sets)), list(range(len(sets))), percent)
        assert all((of[i] == of[j]) == (got[i] == got[j]) for i, j in both)
        assert all(100 * both[min(k), max(k)] >= percent * (sizes[k[0]] + sizes[k[1]] - both[min(k), max(k)]) for k in found)


def test_tree_of_equal_and_empty_paths():
    t = prefixjoin.tree([np.array(x, np.int64) for x in ([1, 2, 3], [1, 2], [1, 2, 3], [], [4])])
    assert sorted(t.leaf[t.leaf >= 0].tolist()) == list(range(5)) and t.lo[0] == 0 and t.hi[0] == 5
    assert prefixjoin.tree_links([], np.zeros(0), np.zeros(0), [], 90)[0] == []


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    for name, n in (("SMALL", 20), ("BLOCK", 30)):
        monkeypatch.setattr(clusters, name, n)
    r = random.Random(7)
    base = prose(r, 200, 5000)
    chain, now = [], prose(r, 120, 5000)
    for _ in range(40):  # each near the one before it, the ends far apart
        chain.append(now)
        now = next(edited(r, now, 1, 1, 2))
    shared = prose(r, 80, 5000)
    texts = [*ODD, "A b C", "a B c", "F g", "f G", *edited(r, base, 70, 0, 5), *chain, *(prose(r, 100, 5000) for _ in range(20)), *(shared + " " + prose(r, 8, 300) for _ in range(40))]
    texts += texts[15:25]  # equal rows under other ids
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids[3] = ids[20] = ids[40] = None
    ids[50] = ids[51] = ids[52]
    texts.append(texts[60]), ids.append(ids[60])  # a repeated row
    df = docs_of(spark, texts, ids)
    got = sorted(tuple(x) for x in prefixjoin.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect() if x[0] is not None)
    want = sorted(x for x in brute_join(texts, ids) if x[0] is not None)
    assert got == want and len({x[2] for x in want}) < len(want) - 60
    more = df.withColumns({c: F.lit(1) for c in ("id", "n", "code", "cluster", "batch", "set_key")})
    assert sorted(tuple(x) for x in prefixjoin.jaccard_join(more.repartition(7)).collect() if x[0] is not None) == want
    lower = sorted(tuple(x) for x in prefixjoin.jaccard_join(df, 70).collect() if x[0] is not None)
    assert lower == sorted(x for x in brute_join(texts, ids, 70) if x[0] is not None)


def test_ngram_join_of_odd_tables(spark):
    df = docs_of(spark, ODD)
    assert prefixjoin.jaccard_join(df.limit(0)).count() == 0
    nulls = sorted(((tuple(x)) for x in prefixjoin.jaccard_join(docs_of(spark, ["a b c d", "a b c d", None], [None, 4, None])).collect()), key=repr)
    assert nulls == sorted([(None, 2, None), (4, 2, 4), (None, 0, None)], key=repr)
    long = prose(random.Random(2), 300_000, 10**6)
    got = [tuple(x) for x in prefixjoin.jaccard_join(docs_of(spark, [long, long + " end", long[: len(long) // 2]])).orderBy("doc_id").collect()]
    assert [x[2] for x in got] == [0, 0, 2]
    same_rows = docs_of(spark, ["x y z w"] * 2000 + [None] * 2000, [5] * 2000 + [None] * 2000)
    assert prefixjoin.jaccard_join(same_rows).groupBy("doc_id", "n_shingles", "component_id").count().count() == 2


# -- 12: hard negatives ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, anchor):
    base = []
    for id_, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or sum((256 * x) ** 2 for x in v) >= 2**61:
            continue
        base.append((id_, (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for i, (a, label, v) in enumerate(base):
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b is None, b, m) for j, (b, m, w) in enumerate(base) if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for s, _, b, _ in [x for x in scored if x[3] == label][:5]:
            some = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, b, k, c, -s, -t) for k, (t, _, c, _) in enumerate(some, 1)]
    return out


def columns(df):
    return [tuple(x) for x in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balltree, "FEW", 100)
    monkeypatch.setattr(balltree, "LEAF", 8)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + r.normal(size=6) * r.choice([0.01, 0.3])).tolist(), int(r.integers(0, 10))) for i in range(900)]
    rows += [(1000 + i, rows[i % 3][1], i % 4) for i in range(150)]  # ties in one very common vector
    rows += [(7 * i, r.normal(size=3).tolist(), 9) for i in range(40)] + [(None, rows[5][1], 1), (None, rows[6][1], 2), (300, rows[7][1], 3), (300, rows[7][1], 3)]
    rows += [(1, None, 1), (100, [1.0, None], 2), (200, [float("nan")] * 6, 2), (400, [float("inf")] * 6, 2), (500, rows[1][1], None), (600, [0.0] * 6, 4), (700, [], 1), (800, [], 2), (900, [1e30] * 6, 1), (1100, [1e5] * 6, 1), (1200, [1.1e5] * 6, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute_negatives(rows, lambda a: a is not None and a % 100 == 0)
    assert sorted(columns(balltree.hard_negatives(df)), key=repr) == sorted(want, key=repr) and len(want) > 150
    more = df.repartition(5).withColumns({c: F.lit(1) for c in ("row", "dim", "v", "block", "positive", "asks")})
    assert sorted(columns(balltree.hard_negatives(more)), key=repr) == sorted(want, key=repr)
    every = sorted(columns(balltree.hard_negatives(df.where("vec_id < 250"), F.lit(True))), key=repr)
    assert every == sorted(brute_negatives([x for x in rows if x[0] is not None and x[0] < 250], lambda a: True), key=repr)
    assert columns(balltree.hard_negatives(df.limit(0))) == [] and columns(balltree.hard_negatives(df.where("vec_id = 100"))) == []


def test_ball_trees_prune(monkeypatch):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(40, 5)) * 5000, 100, 0).round() + r.integers(-50, 50, (4000, 5))
    import pandas as pd

    block = balltree.Block(pd.DataFrame({"row": np.arange(4000), "vec_id": pd.array(np.arange(4000), "Int64"), "label": np.arange(4000) % 3, "v": list(x)}))
    seen, read = [], balltree.Asked.read
    monkeypatch.setattr(balltree.Asked, "read", lambda self, rows, who, *a: (seen.append(len(rows) * len(who)), read(self, rows, who, *a)))
    q = balltree.Asked(x[:50], np.arange(50), np.arange(50) % 3, np.full(50, balltree.NONE), np.full(50, -balltree.NONE - 1), 5)
    block.positives(q)
    scores = np.where((np.arange(4000) % 3 == np.arange(50)[:, None] % 3) & (np.arange(4000) != np.arange(50)[:, None]), x[:50] @ x.T, -np.inf)
    assert (np.sort(scores, 1)[:, :-6:-1] == q.score).all() and sum(seen) < 0.3 * 50 * 4000 / 3


# -- 13: spelling variants ---------------------------------------------------------------------------------------


def brute_variants(rows):
    n = collections.Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    by = collections.defaultdict(set)  # words that agree but for one place
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for s in by.values():
        for a, b in itertools.permutations(s, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(df):
    return sorted(tuple(x) for x in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_spelling_equals_brute_force(spark):
    r = random.Random(5)
    texts = []
    for letters, length in (("ab", 6), ("abc", 7), ("aé\u00D7Z", 5), ("abcdefghijklmnopqrstuvwxyzÿ", 5)):
        for _ in range(60):
            texts.append(" ".join("".join(r.choice(letters) for _ in range(r.randint(4, length + 2))) for _ in range(200)))
    family = "interoperability"
    texts += [" ".join(family[:i] + c + family[i + d :] for i in range(len(family)) for d in (0, 1) for c in "éxyi" for _ in range(r.randint(2, 9))) for _ in range(3)]
    texts += ["aaaaa aaaaaa aaaaaaa aaaaaaaa " * 40, "WORDS words Words1 2words _words-words", "日本 Straße straße STRASSE naïve Naïve\u0131 naïve\u00d7", None, "", "x" * 50000, "prolonged " * 20000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4])]
    df = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    want = brute_variants(rows)
    assert spelled(spelling.variants(df)) == want and len(want) > 2000 and sum(x[5] != x[3] and x[3] is not None for x in want) > 10
    more = df.repartition(3).withColumns({c: F.lit("z") for c in ("word", "n", "at", "node", "letter", "copy", "root")})
    assert spelled(spelling.variants(more)) == want
    assert spelling.variants(df.limit(0)).count() == 0


def test_spelling_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert spelled(queries.QUERIES["op13_spelling"](spark, DATA)) == brute_variants(docs)


def test_words_per_light_edge(spark):
    """No word has more light edges than the logarithm of the number of words, twice for ends of words."""
    r = random.Random(6)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(5, 12))) for _ in range(1000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    most = spelling.light_edges(df, 4).where("letter != ''").groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= 10


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_hard_negatives"])
def test_join_queries_equal_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])
