"""SpotSigs fingerprints, in DataFrame functions only.

A spot is a common word (an anchor) followed by content words; its signature is the anchor
with the next CHAIN content words. Anchors are frequent in running prose and rare in menus,
so signatures fall on the prose. A fingerprint is the set of hashed signatures; a text
without any spot has one signature, its own hash. Two fingerprints are compared by Jaccard.

similar_classes() finds all similar fingerprints of a table: sets are partitioned by length, so
that sets whose lengths alone rule them out never meet, and inside a partition only sets meet that
share one of their rarest signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Anchors: unstressed words of English, French, German and Spanish (fixed values).
ANCHORS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle est et il la le les par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine er für im in ist mit nicht sich und von zu "
    "al asi como con del el en es la las los más no para por que se su un una y"
).split()
CHAIN = 3
#: Hex digits kept of a signature's hash.
DIGITS = 8
HALF = 1 << (4 * DIGITS - 1)
#: Ranges of doc_id that the order of documents is cut into, for each shuffle partition.
RANGES_EACH, RANGES_MOST = 3, 4096


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes of a text (array<int>, never empty); shown() has their digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    tagged = F.transform(F.split(plain, " "), lambda w: F.struct(w.alias("w"), w.isin(ANCHORS).alias("a")))

    def spots(t: Column) -> Column:
        content = F.filter(F.transform(t, lambda x, i: F.struct(x["w"].alias("w"), x["a"].alias("a"), i.alias("i"))), lambda x: ~x["a"])

        def chains(c: Column) -> Column:
            heads = F.transform(c, lambda x, j: F.when((j + CHAIN <= F.size(c)) & (x["i"] > 0) & F.coalesce(F.get(t, x["i"] - 1)["a"], F.lit(False)), F.concat_ws(" ", F.get(t, x["i"] - 1)["w"], *[F.get(c, j + k)["w"] for k in range(CHAIN)])))
            return F.filter(heads, lambda s: s.isNotNull())

        return _let(content, chains)

    found = F.transform(_let(tagged, spots), _hash)
    return F.array_sort(F.array_distinct(_let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(_hash(text))))))


def _hash(s: Column) -> Column:
    """The first hex digits of md5 as an int, in the order of the digits."""
    return (F.conv(F.substring(F.md5(s), 1, DIGITS), 16, 10).cast("long") - HALF).cast("int")


def shown(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + HALF), DIGITS, "0"))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    return _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """Place of a doc_id among descending ranges, by a tree of comparisons; null comes last."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(len(cuts) - lo)
        mid = (lo + hi) // 2
        return F.when(doc_id < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(doc_id.isNull(), F.lit(len(cuts) + 1)).otherwise(tree(0, len(cuts)))


def _with_next(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows (doc_id, text) with sigs, beside next (struct of text, sigs) in descending doc_id, cyclic.

    Documents are cut into ranges of doc_id; each range also gets a copy of the first row of the
    range after it, so a window inside the ranges sees every successor. Text is shuffled once.
    """
    parts = min(RANGES_MOST, RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(x) for x in ids.withColumn("d", F.col("doc_id").cast("double")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.2 / parts)})
    rows = rows.withColumn("part", _range_of(F.col("doc_id"), cuts)).withColumn("ghost", F.lit(0))
    # one row for each range: its first doc_id, and the range before it (cyclic); at most RANGES_MOST + 2 rows
    heads = [(r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()]
    if not heads:
        return rows.withColumn("sigs", signatures(F.col("text"))).withColumn("next", F.struct("text", "sigs"))
    before = [(heads[i - 1][0], part, head) for i, (part, head) in enumerate(heads)]
    marks = spark.createDataFrame(before, "to int, part int, head long")
    ghosts = rows.join(F.broadcast(marks), (rows["part"] == marks["part"]) & rows["doc_id"].eqNullSafe(marks["head"]))
    first = Window.partitionBy("to").orderBy("text")
    ghosts = ghosts.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("ghost"))
    # signatures come after the few ghosts are found, so each text is read for them once
    every = rows.unionByName(ghosts).withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where("ghost = 0")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third replaced by the start of the next
    document's, in descending doc_id; rows with equal doc_id are ordered by their text, rows
    with a null doc_id come last. A null text counts as empty; a single document follows itself.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"))
    rows = _with_next(rows, spark)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    rows = rows.select("*", signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sigs")).alias("fingerprint"),
        shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_classes(docs: DataFrame, threshold: float = 0.8, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id with its class, and pairs (a, b, similarity) of classes at or above the threshold.

    Documents with equal fingerprints are one class, named by its least doc_id; copies are not
    expanded. Sets of lengths n <= m can only be similar if n >= threshold * m, so a set goes to
    the partition of its length and to the next one. There it stands under its n - ceil(t * n) + 1
    rarest signatures: two similar sets share one of them. No pair is left out; the candidates
    are checked on the full sets. Null doc_ids take no part.
    """
    sets = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col(text), F.lit(""))).alias("sigs"))
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs"))
    members = sets.join(classes.select("sigs", "id"), "sigs").select("doc_id", F.col("id").alias("class"))
    flat = classes.select("id", "n", F.explode("sigs").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("df"))
    # rarest first; a class has at most as many rows as signatures
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    first = flat.join(often, "s").withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    spread = first.select("id", "n", "s", F.explode(F.array(F.struct(part.alias("part"), F.lit(True).alias("home")), F.struct((part + 1).alias("part"), F.lit(False).alias("home")))).alias("x")).select("id", "n", "s", "x.*")
    a, b = spread.alias("a"), spread.where("home").alias("b")
    close = F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - 1e-9
    order = F.when(F.col("a.home"), F.col("a.id") < F.col("b.id")).otherwise(F.lit(True))
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.s") == F.col("b.s"))).where(close & order & (F.col("a.id") != F.col("b.id")))
    met = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    left, right = classes.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), classes.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return members, pairs.where(F.col("similarity") >= threshold)


#: The same in DuckDB.
SQL = f"""
with base as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
nexts as (select *, coalesce(lead(text) over (order by doc_id desc nulls last, text), first_value(text) over (order by doc_id desc nulls last, text)) as nt from base),
edits as (select doc_id, n, text, nt, substring(text, 1, n - n // 3) || substring(nt, 1, n // 3) as edited from nexts),
texts as (select doc_id, n, 'a' as k, text as t, edited from edits union all select doc_id, n, 'b', edited, edited from edits union all select doc_id, n, 'c', nt, edited from edits),
tokens as (select *, string_split(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as w from texts),
places as (select *, list_filter(range(1, len(w) + 1), lambda i: not list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))}], w[i])) as c from tokens),
spots as (select *, list_transform(list_filter(range(1, len(c) - {CHAIN - 2}), lambda j: c[j] > 1 and list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))}], w[c[j] - 1])),
  lambda j: w[c[j] - 1] || ' ' || w[c[j]] || ' ' || w[c[j + 1]] || ' ' || w[c[j + 2]]) as s from places),
sigs as (select doc_id, n, k, edited, list_sort(list_distinct(case when len(s) > 0 then list_transform(s, lambda x: md5(x)[1:{DIGITS}]) else [md5(t)[1:{DIGITS}]] end)) as f from spots)
select a.doc_id, a.n as n_chars, sha256(a.edited) as edited_sha256, array_to_string(a.f, ' ') as fingerprint, array_to_string(b.f, ' ') as edited_fingerprint,
  len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)))::double as near_edited,
  len(list_intersect(a.f, c.f)) / (len(a.f) + len(c.f) - len(list_intersect(a.f, c.f)))::double as near_next
from sigs a join sigs b on a.doc_id = b.doc_id and b.k = 'b' join sigs c on a.doc_id = c.doc_id and c.k = 'c' where a.k = 'a'
"""
