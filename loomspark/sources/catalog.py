"""Where tables come from: source strings, a registry of known tables, readers by extension."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import concat
from ..operators.normalize import normalize
from ..operators.sampling import sample, split

HUBS = {"hf": True, "ms": False}


@dataclass(frozen=True)
class Source:
    """hub::name:subset/subset#count."""

    name: str
    subsets: tuple[str, ...] = ()
    count: int | None = None
    hub: str | None = None

    @staticmethod
    def parse(text: str, exists: Callable[[str], bool] = lambda _: False) -> Source:
        """Split off hub, count and subsets in this order; a part that names an existing path stays whole."""
        hub = count = None
        subsets: tuple[str, ...] = ()
        if not exists(text) and "::" in text:
            head, _, text = text.partition("::")
            hub = head.lower() if head.lower() in HUBS else None
        if not exists(text) and "#" in text:
            text, _, n = text.rpartition("#")
            count = int(n)
        if not exists(text) and ":" in text:
            text, _, names = text.partition(":")
            subsets = tuple(s.strip() for s in names.split("/"))
        return Source(text.strip(), subsets, count, hub)

    def __str__(self) -> str:
        return (f"{self.hub}::" if self.hub else "") + self.name + (f":{'/'.join(self.subsets)}" if self.subsets else "") + (f"#{self.count}" if self.count is not None else "")


def parsed(text: Column, exists: Callable[[Column], Column] = lambda _: F.lit(False)) -> Column:
    """Source.parse() of a column of source strings: struct of hub, name, subsets and count (null where it is no number)."""

    def cut(t: Column, sign: str, last: bool = False) -> tuple[Column, Column, Column]:
        """Whether the sign splits t, what is before it, and what is after it."""
        has = ~exists(t) & t.contains(sign)
        before = F.substring_index(t, sign, 1) if not last else F.substr(t, F.lit(1), F.char_length(t) - F.char_length(F.substring_index(t, sign, -1)) - len(sign))
        return has, before, F.substr(t, F.char_length(before) + len(sign) + 1)

    has, head, rest = cut(text, "::")
    hub = F.when(has & F.lower(head).isin(*HUBS), F.lower(head))
    text = F.when(has, rest).otherwise(text)
    has, rest, n = cut(text, "#", True)
    count, text = F.when(has, n).try_cast("int"), F.when(has, rest).otherwise(text)
    has, rest, names = cut(text, ":")
    subsets = F.when(has, F.transform(F.split(names, "/"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    return F.struct(hub.alias("hub"), F.trim(F.when(has, rest).otherwise(text)).alias("name"), subsets.alias("subsets"), count.alias("count"))


@dataclass(frozen=True)
class Subset:
    name: str = "default"
    path: str | None = None
    splits: tuple[str, ...] = ("train",)
    weak: bool = False
    transform: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Entry:
    """A registered table: ids, path, subsets, columns to rename, a transform, tags."""

    name: str
    path: str | None = None
    ids: tuple[str, ...] = ()
    subsets: tuple[Subset, ...] = (Subset(),)
    columns: dict[str, str] = field(default_factory=dict)
    messages: dict[str, str] = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] | None = None
    load: Callable[[SparkSession, Entry], DataFrame] | None = None
    tags: tuple[str, ...] = ()


class Catalog:
    def __init__(self):
        self.entries: dict[str, Entry] = {}

    def register(self, entry: Entry, exist_ok: bool = False) -> Entry:
        if entry.name in self.entries and not exist_ok:
            raise ValueError(f"{entry.name} is registered already")
        self.entries[entry.name] = entry
        return entry

    def register_json(self, text: str, base: str = "", exist_ok: bool = False) -> list[Entry]:
        """Entries from a JSON list; relative paths are taken from base; strings stand for bare ids."""
        out = []
        for item in json.loads(text):
            item = {"name": item} if isinstance(item, str) else dict(item)
            path = item.get("path")
            if path and base and not path.startswith("/") and "://" not in path:
                path = f"{base.rstrip('/')}/{path}"
            subsets = tuple(Subset(s) if isinstance(s, str) else Subset(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for s in item.get("subsets", ["default"]))
            out.append(self.register(Entry(item.get("name") or path, path, tuple(item.get("ids", ())), subsets, item.get("columns", {}), item.get("messages", {}), tags=tuple(item.get("tags", ()))), exist_ok))
        return out

    def find(self, name: str) -> Entry | None:
        """By name, path or id; else by the last part of the name."""
        for e in self.entries.values():
            if name in (e.name, e.path, *e.ids):
                return e
        last = PurePosixPath(name.rstrip("/")).name
        return next((e for e in self.entries.values() if last in {PurePosixPath(x).name for x in (e.name, e.path or "", *e.ids) if x}), None)


CATALOG = Catalog()


def chosen_subsets(entry: Entry, names: tuple[str, ...]) -> list[Subset]:
    """None: the only one, or default. all: every one that is not weak. Unknown names make their own."""
    known = {s.name: s for s in entry.subsets}
    if not names:
        return [entry.subsets[0] if len(entry.subsets) == 1 else known.get("default", entry.subsets[0])]
    if names == ("all",):
        return [s for s in entry.subsets if not s.weak]
    return [known.get(n, Subset(n)) for n in names]


def register_tables(base: str, catalog: Catalog = CATALOG) -> Catalog:
    """A small catalog of its own: the synthetic tables of a folder as chat data."""
    from ..operators.expand import gathered
    from ..operators.normalize import from_messages

    def chats(df: DataFrame) -> DataFrame:
        turns = gathered(df.select("conv_id", "turn", "role", F.col("text").alias("content")), ["conv_id"], "turn", ["role", "content"], "messages")
        return from_messages(turns)

    catalog.register(Entry("tables/conversations", f"{base}/conversations.parquet", transform=chats, tags=("chat",)), exist_ok=True)
    catalog.register(Entry("tables/documents", f"{base}/documents.parquet", columns={"source": "channel"}, tags=("pretrain",)), exist_ok=True)
    catalog.register(Entry("tables/benchmark", f"{base}/benchmark.parquet", tags=("pretrain",)), exist_ok=True)
    return catalog


def configured(catalog: Catalog, name: str, recipe: Callable[..., DataFrame], **settings) -> Entry:
    """An entry whose transform is a recipe with settings filled in, such as a model's name and author."""
    entry = catalog.find(name)
    if entry is None:
        raise KeyError(name)
    return catalog.register(replace(entry, transform=lambda df: recipe(df, **settings)), exist_ok=True)


def read_file(spark: SparkSession, path: str, kind: str | None = None, array: bool = False) -> DataFrame:
    """A file or folder by extension: jsonl, json, csv, parquet, orc, txt. Empty CSV fields are empty strings."""
    kind = kind or PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if kind in ("jsonl", "json"):
        return spark.read.option("multiLine", array).json(path)
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return df.na.fill("")
    if kind in ("txt", "text"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    if kind == "arrow":
        import pyarrow.ipc as ipc

        return spark.createDataFrame(ipc.open_file(path).read_all())
    return spark.read.format(kind or "parquet").load(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Dicts with unequal keys; missing values are null."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)


def rows_of_json(df: DataFrame, text: str) -> DataFrame:
    """The columns of a column of JSON objects with unequal keys; missing values are null.

    The types come from one pass over all rows, in which Spark merges the schemas of the objects.
    """
    schema = df.agg(F.schema_of_variant_agg(F.try_parse_json(text))).first()[0]
    if not schema.startswith("OBJECT<"):
        raise ValueError(f"rows are no objects: {schema}")
    schema = schema.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING")
    return df.select(F.from_json(text, schema).alias("r")).select("r.*")


def read_cached(spark: SparkSession, path: str, count: int | None = None, most: int | None = None, key: str = "id", length: str = "length") -> DataFrame:
    """A written data set again: sampled if a count is given, without rows longer than most."""
    from ..operators.filters import by_length

    df = spark.read.parquet(path)
    if count is not None:
        df = sample(df, count, key).drop("copy")
    return df if most is None else by_length(df, most, length)


def load_one(spark: SparkSession, text: str, catalog: Catalog = CATALOG, keep: tuple[str, ...] = (), exists: Callable[[str], bool] = lambda _: False) -> DataFrame:
    """The normalised rows of one source string."""
    source = Source.parse(text, exists)
    entry = catalog.find(source.name) or Entry(source.name, source.name)
    frames = []
    for s in chosen_subsets(entry, source.subsets):
        for part in s.splits if s.path is None and len(s.splits) > 1 else (None,):
            at = s.path or entry.path or entry.name
            df = entry.load(spark, replace(entry, path=at)) if entry.load else read_file(spark, f"{at}/{part}" if part else at)
            transform = s.transform or entry.transform
            frames.append(transform(df) if transform else normalize(df, entry.columns, keep))
    out = concat(frames)
    return out if source.count is None else sample(out, source.count, keep[0]).drop("copy") if keep else out.limit(source.count)


def load(spark: SparkSession, texts: list[str], ratio: float = 0.0, key: str = "id", catalog: Catalog = CATALOG) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, validation) of several sources."""
    frames = [split(load_one(spark, t, catalog, (key,)), ratio, key) for t in texts]
    every = concat(frames)
    if every is None:
        return None, None
    return every.where("part = 'train'").drop("part"), every.where("part = 'val'").drop("part")
