"""URL verdicts: rules first, link-graph propagation for the rest; DataFrame functions only.

Hosts form a graph: a link in a page's html is an edge from its host to the linked host. A
host and its parent domain, where both have pages, count as linked both ways, and every
host links to itself, so that a host without links keeps what it has. Hosts whose pages a
rule allows are trusted seeds, hosts whose pages a rule blocks are distrusted seeds, by the number of
such pages. Trust is a personalised PageRank along the edges; distrust runs the same
against them. A host is blocked where the distrust that ends on it, counted in blocked
pages, is at least BLOCKED of its pages, and more than RATIO times its trust.

The rounds go on until all mass that could still move is at most TOLERANCE of a page: after
n rounds that is DAMPING**n of the seeds' pages, so their number follows from the seeds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, files_for, materialise

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Pages (of a host's trust or distrust) that may still move when the rounds end, and rounds of one written step.
TOLERANCE, FUSED = 0.01, 6
#: Thresholds of a host: distrust in pages against its pages, and against trust in pages.
BLOCKED, RATIO = 0.5, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (null if none); equally long rules go by their text."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of hosts, from (host, html); counted before the shuffle."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")).where("src != dst and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    hosts = pages.select("host").distinct()
    up = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src != dst")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    every = links.select(F.explode(F.array("src", "dst")).alias("host")).union(hosts).distinct()
    one = up.union(up.select("dst", "src")).union(every.select("host", "host")).toDF("src", "dst").withColumn("weight", F.lit(1).cast("long"))
    return links.unionByName(one).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rounds_for(pages: float, damping: float = DAMPING) -> int:
    """Rounds after which at most TOLERANCE of so many pages of seeds is not where it ends."""
    return max(1, math.ceil(round(math.log(max(pages, 1) / TOLERANCE) / -math.log(damping), 6)))


def propagate(edges: DataFrame, seeds: DataFrame, files: int | None = None, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank) from edges (src, dst, weight) and seeds (kind, host, weight).

    kind is trust (along edges) or distrust (against them); both run in the same joins. What a
    host has is split by edge weight, so ranks of a kind add up to its seeds' weights. The
    ranks go to the shared folder every FUSED rounds.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    ways = materialise(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), files)
    start = materialise(seeds.select("kind", "host", F.col("weight").cast("double").alias("seed")), files)
    rounds = rounds_for(start.agg(F.sum("seed")).first()[0] or 0.0, damping) if rounds is None else rounds
    rank, written = start.select("kind", "host", F.col("seed").alias("rank")), None
    for turn in range(1, rounds + 1):
        step = ways.join(rank.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("r"))
        step = step.unionByName(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("r")))
        rank = step.groupBy("kind", "host").agg(F.sum("r").alias("rank"))
        if turn % FUSED == 0 or turn == rounds:
            rank = materialise(rank, files)
            if written is not None:
                discard(written)
            written = rank
    discard(ways)
    discard(start)
    return rank


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust for every row.

    A null url, or one without ://, has empty host and path; such rows, and hosts that no seed
    reaches, are allowed. Repeated rows are judged alike; null html has no links.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("by_rule", verdict_of(F.col("rule"), rules))
    named = rows.where("host != ''")
    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = named.where("by_rule is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("weight"))
    files = files_for(pages)
    rank = propagate(host_edges(named.select("host", "html")), seeds, files)
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.round("rank", 9))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    sizes = named.groupBy("host").agg(F.count("*").alias("pages"))
    # written, so that the last join reads it through its own shuffle and AQE may split a host with very many pages
    hosts = materialise(sizes.join(rank.groupBy("host").agg(*kinds), "host", "left").na.fill(0.0, ["trust", "distrust"]), files)
    out = rows.drop("html").join(hosts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCKED * F.col("pages")) & (F.col("distrust") > RATIO * F.col("trust"))
    by_graph = F.when(bad, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")


def _sql() -> str:
    """The registered query in DuckDB: the same rounds, as many as the seeds' pages ask for."""
    link = LINK.replace("'", "''")
    lower = f"'{UPPER}', '{LOWER}'"
    rule = "case"
    for name, _ in sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True):
        at = name.index("/")
        rule += f" when (host = '{name[:at]}' or ends_with(host, '.{name[:at]}')) and starts_with(path, '{name[at:]}') then '{name}'"
    verdict = "case rule " + " ".join(f"when '{n}' then '{v}'" for n, v in RULES) + " end"
    return f"""
with recursive cut as (select page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {lower}), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
ruled as (select *, {rule} end as rule from cut), judged as (select *, {verdict} as by_rule from ruled), named as (select * from judged where host <> ''),
links as (select src, dst, count(*) as weight from (select host as src, translate(d, {lower}) as dst from (select host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) as d from named)) where src <> dst and dst <> '' group by src, dst),
hosts as (select distinct host from named), ups as (select host as src, regexp_replace(host, '^[^.]*\\.', '') as dst from hosts), up as (select src, dst from ups where src <> dst and dst in (select host from hosts)),
every as (select host from hosts union select src from links union select dst from links),
edges as (select src, dst, sum(weight) as weight from (select src, dst, weight from links union all select src, dst, 1 from up union all select dst, src, 1 from up union all select host, host, 1 from every) group by src, dst),
both_ as (select 'trust' as kind, src, dst, weight from edges union all select 'distrust', dst, src, weight from edges),
ways as (select kind, src, dst, weight / (sum(weight) over (partition by kind, src))::double as share from both_),
start as (select case when by_rule = 'allow' then 'trust' else 'distrust' end as kind, host, count(*)::double as seed from named where by_rule is not null group by 1, 2),
last as (select greatest(1, ceil(round(ln(greatest(coalesce(sum(seed), 0), 1) / {TOLERANCE}) / -ln({DAMPING}), 6)))::int as n from start),
steps as (select 0 as turn, kind, host, seed as rank from start union all select turn, kind, host, sum(r) as rank from (
  select p.turn + 1 as turn, w.kind, w.dst as host, p.rank * w.share * {DAMPING}::double as r from ways w join steps p on p.kind = w.kind and p.host = w.src where p.turn < (select n from last)
  union all select t.turn + 1, kind, host, seed * (1 - {DAMPING}::double) from start, (select distinct turn from steps where turn < (select n from last)) t) group by turn, kind, host),
ranks as (select host, coalesce(sum(case when kind = 'trust' then round(rank, 9) end), 0) as trust, coalesce(sum(case when kind = 'distrust' then round(rank, 9) end), 0) as distrust from steps where turn = (select n from last) group by host),
sizes as (select host, count(*) as pages from named group by host)
select j.page_id, j.host, j.path, j.rule, coalesce(j.by_rule, case when coalesce(k.distrust, 0) > 0 and k.distrust >= {BLOCKED} * s.pages and k.distrust > {RATIO} * k.trust then 'block' else 'allow' end) as verdict,
  coalesce(k.trust, 0)::double as trust, coalesce(k.distrust, 0)::double as distrust
from judged j left join sizes s on s.host = j.host left join ranks k on k.host = j.host and s.host is not null
"""


SQL = _sql()
