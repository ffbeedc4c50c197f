"""Where users put their own code: row transforms, rewards, metrics, files with registrations."""

from __future__ import annotations

import asyncio
import hashlib
import importlib.util
import inspect
import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REWARDS: dict[str, Callable[..., Any]] = {}
#: States of a metric that one task merges.
FAN = 16



def row_transform(df: DataFrame, fn: Callable[[dict], dict | list[dict] | None], schema: str, strict: bool = False) -> DataFrame:
    """A Python function of a row: a dict stays a row, a list becomes rows, None drops it.

    A row that raises is dropped, or stops the job if strict. Runs in Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0].strip("`") for f in _fields(schema)]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    got = fn(row)
                except Exception:
                    if strict:
                        raise
                    continue
                out += got if isinstance(got, list) else [got] if got is not None else []
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names)

    return df.mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]


def reward(name: str):
    """Register a reward: a function of a list of completions and keyword columns, plain or async."""

    def put(fn):
        REWARDS[name] = fn
        return fn

    return put


def scored(df: DataFrame, names: list[str], completion: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One column for each registered reward; None becomes null. Async rewards of a batch run together."""
    fns = {n: REWARDS[n] for n in names}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, more = pdf[completion].tolist(), {c: pdf[c].tolist() for c in columns}
            got = {n: fn(texts, **more) for n, fn in fns.items()}
            waiting = [n for n, g in got.items() if inspect.isawaitable(g)]
            if waiting:

                async def gather(waiting=waiting, got=got):
                    return await asyncio.gather(*[got[n] for n in waiting])

                got |= dict(zip(waiting, asyncio.run(gather()), strict=True))
            yield pdf.assign(**{n: pd.Series(g, dtype="float64").to_numpy() for n, g in got.items()})

    return df.mapInPandas(run, fields + "".join(f", `{n}` double" for n in names)).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


class Metric:
    """A metric with state that merges: start, update with a batch, merge two states, result.

    A state is any value that can be pickled and that stays small however many rows it has seen; by default
    a list of numbers whose merge is their sum.
    """

    def start(self) -> Any:
        raise NotImplementedError

    def update(self, state: Any, batch: pd.DataFrame) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        return [x + y for x, y in zip(a, b, strict=True)]

    def result(self, state: Any) -> Any:
        raise NotImplementedError

    def over(self, df: DataFrame) -> Any:
        """Each task makes one state; FAN states at a time merge in tasks until one is left, which comes back."""

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = self.start()
            for pdf in batches:
                if len(pdf):
                    state = self.update(state, pdf)
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

        def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # by place, so that a merge that is not commutative gives one result
            rows = sorted((at, state) for pdf in batches for at, state in pdf.itertuples(index=False))
            if rows:
                merged = reduce(self.merge, (pickle.loads(state) for _, state in rows))
                yield pd.DataFrame({"at": [rows[0][0] // FAN], "state": [pickle.dumps(merged)]})

        states, parts = df.mapInPandas(make, "at long, state binary"), df.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // FAN)
            states = states.repartitionById(parts, F.floor(F.col("at") / FAN).cast("int")).mapInPandas(join, "at long, state binary")
        rows = states.collect()  # one
        return self.result(pickle.loads(rows[0]["state"]) if rows else self.start())


class Mean(Metric):
    """The mean of a column; a fixed value if there are no rows."""

    def __init__(self, column: str, empty: float = 0.0):
        self.column, self.empty = column, empty

    def start(self) -> list[float]:
        return [0.0, 0.0]

    def update(self, state: list[float], batch: pd.DataFrame) -> list[float]:
        return [state[0] + float(batch[self.column].sum()), state[1] + float(batch[self.column].count())]

    def result(self, state: list[float]) -> float:
        return state[0] / state[1] if state[1] else self.empty


class Largest(Metric):
    """The n largest values of a column, largest first: a state that is no sum."""

    def __init__(self, column: str, n: int):
        self.column, self.n = column, n

    def start(self) -> list:
        return []

    def update(self, state: list, batch: pd.DataFrame) -> list:
        return self.merge(state, batch[self.column].dropna().nlargest(self.n).tolist())

    def merge(self, a: list, b: list) -> list:
        return sorted(a + b, reverse=True)[: self.n]

    def result(self, state: list) -> list:
        return state


class Distinct(Metric):
    """The number of distinct texts of a column from its k least hashes: exact up to k, else an estimate of about 1 / sqrt(k)."""

    def __init__(self, column: str, k: int = 1024):
        self.column, self.k = column, k

    def start(self) -> list[int]:
        return []

    def update(self, state: list[int], batch: pd.DataFrame) -> list[int]:
        return self.merge(state, [int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big") for x in batch[self.column].dropna().unique()])

    def merge(self, a: list[int], b: list[int]) -> list[int]:
        return sorted({*a, *b})[: self.k]

    def result(self, state: list[int]) -> float:
        return float(len(state)) if len(state) < self.k else (self.k - 1) * 2.0**64 / (state[-1] + 1)


def load_file(path: str):
    """Run a user's file for its registrations."""
    spec = importlib.util.spec_from_file_location("loom_user", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module
