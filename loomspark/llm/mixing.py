"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every copy of a document gets a virtual finish time: the words of its source that come up
to it in shuffled order, divided by the source's target. Copies are then taken in order of
that time until the total budget is used, so each source gets about its target.

Prefix sums never run through one task. Inside a source they go by slices of the shuffle
hash (sums of slices, then a window inside each slice), so a source with a third of all
rows is spread over 16 ** SLICE_DIGITS groups. Globally they go by ranges of the finish time: the
one range that holds the cut is cut again until it has at most EDGE_ROWS copies, only those are sorted,
and the cut comes back as a single row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, files_for, materialise

#: Hex digits of the shuffle hash that name a slice of a source.
SLICE_DIGITS = 3
#: Ranges of finish times below 1; above, ranges widen with the time.
RANGES, RANGES_LOG = 8192, 256
#: Copies that one window orders at the cut; a range with more is cut into RANGES again.
EDGE_ROWS = 500_000


@dataclass(frozen=True)
class MixPlan:
    """weights repeat over the sources in code point order (null last); share of all sizes is the budget."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """Water-filling over (skey, source_size): one row per source, so windows over all of them are small.

    A source gets level * weight, or cap * size where that is less; the level is the one at
    which all targets add up to the budget.
    """
    every, asc = Window.orderBy("skey"), Window.orderBy("ratio", "skey")
    whole = Window.partitionBy()
    out = sizes.withColumn("__at", (F.row_number().over(every) - 1) % len(plan.weights))
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in plan.weights]), (F.col("__at") + 1).cast("int")))
    out = out.withColumn("ratio", plan.cap * F.col("source_size") / F.col("weight"))
    out = out.withColumn("__budget", plan.share * F.sum("source_size").over(whole))
    out = out.withColumn("__before", plan.cap * F.coalesce(F.sum("source_size").over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("__rest", F.sum("weight").over(asc.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("__level", (F.col("__budget") - F.col("__before")) / F.col("__rest"))
    out = out.withColumn("__level", F.max(F.when(F.col("__level") <= F.col("ratio"), F.col("__level"))).over(whole))
    full = plan.cap * F.col("source_size")
    target = F.when(F.col("__level").isNull() | (F.col("ratio") < F.col("__level")), full).otherwise(F.col("__level") * F.col("weight"))
    return out.select("skey", "source_size", "weight", target.alias("target"), F.col("__budget").alias("budget"))


def _range(at: Column) -> Column:
    """The finish-time range; times from 1 on go by their logarithm."""
    return F.when(at < 1, F.floor(at * RANGES)).otherwise(RANGES + F.floor(F.log(F.greatest(at, F.lit(1.0))) * RANGES_LOG)).cast("long")


def _edge(copies: DataFrame, place: Column, before: int, budget: float) -> Row | None:
    """The last range of place that begins within the budget: its rows n, least and greatest time, and the sizes before it."""
    sums = copies.groupBy(place.alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    sums = sums.withColumn("before", before + F.sum("size").over(Window.orderBy("range")) - F.col("size"))  # a bounded number of ranges
    return sums.where(F.col("before") <= budget).orderBy(F.desc("range")).first()


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), keep: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target, copies (0 to 2) and taken (size * copies) to every row.

    A null source is a source of its own, last in order; a null text has size 0. Rows
    without words are never taken. The order is a hash of the seed, doc_id and the text's md5, so
    rows that share a doc_id or have none are separate documents, spread like all others, and
    reruns take the same texts however the rows are partitioned; rows that agree in all three
    are one text to the mix, and it does not matter which of them is taken. An empty table
    gives an empty result. Only keep and what is computed travel through the shuffle.
    """
    h = F.md5(F.concat_ws(":", F.lit(plan.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], h.alias("__h"), word_count(F.col(text)).alias("size"), F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("skey"))
    rows = rows.withColumn("slice", F.substring("__h", 1, SLICE_DIGITS))
    within = Window.partitionBy("skey", "slice")
    rows = materialise(rows.withColumn("__cum", F.sum("size").over(within.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))), files_for(docs))

    slices = rows.groupBy("skey", "slice").agg(F.sum("size").alias("n"))
    slices = slices.withColumn("__off", F.sum("n").over(Window.partitionBy("skey").orderBy("slice")) - F.col("n"))
    goals = targets(slices.groupBy("skey").agg(F.sum("n").alias("source_size")), plan)
    place = slices.select("skey", "slice", "__off").join(goals, "skey")
    timed = rows.join(place, ["skey", "slice"])
    first, second = F.col("__off") + F.col("__cum"), F.col("source_size") + F.col("__off") + F.col("__cum")
    timed = timed.withColumn("__t0", first / F.nullif("target", F.lit(0.0))).withColumn("__t1", second / F.nullif("target", F.lit(0.0)))

    # times of a source are all different, so time, copy and source tell any two copies apart
    copies = timed.where("size > 0").select(F.explode(F.array(*[F.struct(F.col(f"__t{e}").alias("t"), F.lit(e).alias("e")) for e in (0, 1)])).alias("c"), "skey", "size", "budget").select("c.t", "c.e", "skey", "size", "budget")
    budget = copies.agg(F.max("budget")).first()[0]
    edge, cut = None if budget is None else _edge(copies, _range(F.col("t")), 0, budget), None
    while edge and edge["n"] > EDGE_ROWS and edge["lo"] < edge["hi"]:
        inside = copies.where(F.col("t").between(edge["lo"], edge["hi"]))
        edge = _edge(inside, F.floor((F.col("t") - edge["lo"]) / (edge["hi"] - edge["lo"]) * RANGES), edge["before"], budget)
    if edge:
        near = copies.where(F.col("t").between(edge["lo"], edge["hi"]))
        near = near.withColumn("cum", edge["before"] + F.sum("size").over(Window.orderBy("t", "e", "skey").rowsBetween(Window.unboundedPreceding, 0)))
        cut = near.where(F.col("cum") <= budget).agg(F.max(F.struct("t", "e", "skey")).alias("key")).first()["key"]

    def taken(e: int) -> Column:
        if not edge:
            return F.lit(0)
        at = F.col(f"__t{e}")
        early = at < edge["lo"]
        if cut:
            early |= (at < cut["t"]) | ((at == cut["t"]) & ((F.lit(e) < cut["e"]) | ((F.lit(e) == cut["e"]) & (F.col("skey") <= cut["skey"]))))
        return F.when((F.col("size") > 0) & early, 1).otherwise(0)

    out = timed.withColumn("copies", taken(0) + taken(1))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


#: The registered query in DuckDB: the same order and prefix sums, without slices and ranges.
SQL = """
with base as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h, row_number() over () as r from documents),
sources as (select source, sum(size)::bigint as s, row_number() over (order by source nulls last) as p from base group by source),
weighed as (select *, [3, 1, 2][(p - 1) % 3 + 1] as w, 2.0::double * s / [3, 1, 2][(p - 1) % 3 + 1] as ratio, 1.5::double * sum(s) over () as budget from sources),
levels as (select *, (budget - 2.0::double * coalesce(sum(s) over (order by ratio, p rows between unbounded preceding and 1 preceding), 0))
  / sum(w) over (order by ratio, p rows between current row and unbounded following) as l from weighed),
goals as (select *, max(case when l <= ratio then l end) over () as level from levels),
targets as (select source, s, budget, case when level is null or ratio < level then 2.0::double * s else level * w end as target from goals),
rows_ as (select b.*, t.s as source_size, t.target, t.budget, sum(b.size) over (partition by b.source order by b.h rows between unbounded preceding and current row) as cum
  from base b join targets t on b.source is not distinct from t.source),
copies as (select *, (e * source_size + cum)::double / target as vt from rows_, (select unnest([0, 1]) as e) where size > 0),
ordered as (select *, sum(size) over (order by vt, e, source nulls last rows between unbounded preceding and current row) as upto from copies),
taken as (select r, count(*) as copies from ordered where upto <= budget group by r)
select r.doc_id, r.size, r.source_size, r.target, coalesce(t.copies, 0)::int as copies, (r.size * coalesce(t.copies, 0))::bigint as taken
from rows_ r left join taken t on r.r = t.r
"""
