"""Queries over sources and sinks: source strings, the catalog, files that are written and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize, recipes
from ..sources import catalog, sinks
from ..sources.scratch import folder
from .registry import query, table
from .sets import DOCS, digest, docs


def plain(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source", "lang", "h")


TEXT = "case doc_id % 5 when 0 then 'HF::' || source || '/' || lang || ':' || lang || '/ b #' || doc_id when 1 then 'zz::' || source when 2 then ' ' || lang || '#5#' || doc_id when 3 then source || ':all' else 'kept#1:' || source end"


@query(f"""with t as (select doc_id, source, lang, {TEXT} as text from documents)
select doc_id, text, case when doc_id % 5 = 0 then 'hf' end as hub, case doc_id % 5 when 0 then source || '/' || lang when 1 then source when 2 then lang || '#5' when 3 then source else text end as name,
case doc_id % 5 when 0 then lang || ',b' when 3 then 'all' else '' end as subsets, case when doc_id % 5 in (0, 2) then doc_id::int end as n from t""")
def source_strings(spark, sf_dir):
    """hub::name:subset/subset#count in a table's rows, and paths that exist."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(TEXT).alias("text"))
    s = d.select("doc_id", "text", catalog.parsed(F.col("text"), lambda t: t.startswith("kept")).alias("s"))
    return s.select("doc_id", "text", "s.hub", "s.name", F.array_join("s.subsets", ",").alias("subsets"), F.col("s.count").alias("n"))


@query(f"with {DOCS} select 'documents' as name, count(*) as n, count(distinct source) as n_channels from d union all select 'benchmark', count(*), 0 from benchmark")
def catalog_tables(spark, sf_dir):
    """Tables of a catalog under their names, found by the last part as well."""
    known = catalog.register_tables(sf_dir, catalog.Catalog())
    d = catalog.load_one(spark, "tables/documents", known).select(F.lit("documents").alias("name"), "channel")
    b = catalog.load_one(spark, "benchmark", known).select(F.lit("benchmark").alias("name"), F.lit(None).cast("string").alias("channel"))
    return d.unionByName(b).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("n_channels"))


@query("with c as (select conv_id, list({'role': role, 'content': text} order by turn) as m from conversations group by conv_id) select md5(array_to_string(list_transform(m, lambda x: x.role || ':' || x.content), '|')) as digest, count(*) as n from c group by digest")
def catalog_chats(spark, sf_dir):
    """A registered table with a transform of its own."""
    known = catalog.register_tables(sf_dir, catalog.Catalog())
    m = catalog.load_one(spark, "tables/conversations", known)
    return m.select(F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


@query(f"with {DOCS}, t as (select source, lang from d) select md5('user:' || source || '|assistant:' || lang) as digest, count(*) as n from t group by 1")
def configured_entry(spark, sf_dir):
    """A registered table whose transform is a recipe with its settings filled in."""
    known = catalog.register_tables(sf_dir, catalog.Catalog())
    catalog.configured(known, "tables/documents", recipes.query_response, query="source", response="lang")
    m = catalog.load_one(spark, "tables/documents", known)
    return m.select(F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


@query(f"with {DOCS} select part, md5(k) as digest, count(*) as n from (select 'user:' || source || '|assistant:' || h as k, 'default' as part from d union all select 'user:' || lang || '|assistant:' || h, 'b' from d union all select 'user:' || lang || '|assistant:' || h, 'a' from d) group by part, md5(k)")
def catalog_subsets(spark, sf_dir):
    """Subsets by default, by name and all that are not weak, with files and renamed columns of their own; every row of each, copies counted."""
    at = folder(spark)
    plain(spark, sf_dir).select(F.col("source").alias("q"), F.col("h").alias("a")).write.parquet(f"{at}/one")
    plain(spark, sf_dir).select(F.col("lang").alias("q"), F.col("h").alias("a")).write.parquet(f"{at}/two")
    known = catalog.Catalog()
    items = [{"name": "sets/x", "path": "one", "ids": ["org/x"], "columns": {"q": "query", "a": "response"}, "subsets": ["default", {"name": "two", "path": f"{at}/two", "weak": True}]}]
    known.register_json(json.dumps(items), at)
    out = None
    for text, part in (("x", "default"), ("org/x:two", "b"), ("sets/x:two", "a")):
        said = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
        got = catalog.load_one(spark, text, known).select(F.when(F.size("messages") == 2, said).alias("k"), F.lit(part).alias("part"))  # a null query is no message: null in SQL
        out = got if out is None else out.unionByName(got)
    return out.groupBy("part", F.md5("k").alias("digest")).agg(F.count("*").alias("n"))


@query(f"with {DOCS} select doc_id, kind, md5(source || '|' || case when kind = 'csv' and lang = 'fr' then '' else lang end || '|' || h) as digest from d, (select unnest(['jsonl', 'json', 'csv', 'orc', 'parquet']) as kind)")
def files_by_extension(spark, sf_dir):
    """Rows written in each format and read again; empty CSV fields are empty strings."""
    at, out = folder(spark), None
    d = plain(spark, sf_dir)
    sinks.write_jsonl(d, f"{at}/x.jsonl")
    sinks.write_jsonl(d, f"{at}/x.json")
    d.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang"))).write.option("header", True).csv(f"{at}/x.csv")
    d.write.orc(f"{at}/x.orc")
    d.write.parquet(f"{at}/x.parquet")
    for kind in ("jsonl", "json", "csv", "orc", "parquet"):
        got = catalog.read_file(spark, f"{at}/x.{kind}").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(kind).alias("kind"), F.md5(F.concat_ws("|", "source", "lang", "h")).alias("digest"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"with {DOCS} select doc_id, md5('user:' || source || '|assistant:' || h) as digest from d")
def jsonl_with_schema(spark, sf_dir):
    """JSON lines appended in two goes, read with a given schema and normalised."""
    at = f"{folder(spark)}/x.jsonl"
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("query"), F.col("h").alias("response"))
    sinks.write_jsonl(d.where("doc_id % 2 = 0"), at)
    sinks.write_jsonl(d.where("doc_id % 2 = 1"), at, append=True)
    return digest(normalize.normalize(catalog.read_jsonl(spark, at, "doc_id long, query string, response string"), keep=("doc_id",)))


@query("select case when doc_id % 2 = 0 then doc_id end as a, case when doc_id % 2 = 0 then lang end as b, case when doc_id % 2 = 1 then n_chars + 0.5::double end as c from documents")
def rows_with_unequal_keys(spark, sf_dir):
    """JSON objects whose keys differ from row to row, as columns."""
    d = table(spark, sf_dir, "documents")
    even = F.to_json(F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b")))
    rows = d.select(F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.to_json(F.struct((F.col("n_chars") + F.lit(0.5).cast("double")).alias("c")))).alias("j"))
    return catalog.rows_of_json(rows, "j").select("a", "b", F.col("c").cast("double").alias("c"))


@query("select part, count(*) as n from (select case when doc_id % 4 = 0 then 'val' else 'train' end as part from documents) group by part")
def encoded_parts(spark, sf_dir):
    """An encoded data set: train and val folders."""
    at, d = folder(spark), plain(spark, sf_dir)
    sinks.write_encoded(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), at)
    return table_of(spark, f"{at}/train", "train").unionByName(table_of(spark, f"{at}/val", "val")).groupBy("part").agg(F.count("*").alias("n"))


def table_of(spark, path: str, part: str) -> DataFrame:
    return spark.read.parquet(path).select(F.lit(part).alias("part"))


@query(f"with {DOCS} select doc_id, h from d where doc_id in (3, 50, 77)")
def shard_lookup(spark, sf_dir):
    """Files ranged by key, and a lookup that the file statistics serve."""
    at = folder(spark)
    sinks.write_shards(plain(spark, sf_dir), at, 100, "doc_id")
    return sinks.lookup(spark, at, "doc_id", [3, 50, 77]).select("doc_id", "h")


@query("select b as batch, count(*) as n, 1 as written from (select doc_id // 50 as b from documents) group by b")
def resumed_batches(spark, sf_dir):
    """A run that broke off after two batches goes on with the others; each batch is written once."""
    at = folder(spark)
    d = plain(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 50))
    first = sinks.write_batches(d.where("batch < 2"), at, "batch")
    later = sinks.write_batches(d, at, "batch")
    times = {b: (first + later).count(b) for b in {*first, *later}}
    marks = spark.createDataFrame(list(times.items()), "batch long, written int")
    n = spark.read.parquet(at).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))
    return n.join(marks, "batch").select("batch", "n", "written")


@query(f"with {DOCS} select doc_id, n_chars from d where n_chars <= 400")
def cached_rows(spark, sf_dir):
    """A written data set again, without rows that are too long."""
    at = folder(spark)
    docs(spark, sf_dir).select("doc_id", "n_chars").write.parquet(at)
    return catalog.read_cached(spark, at, most=400, key="doc_id", length="n_chars").select("doc_id", "n_chars")
