"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(use: Callable[..., Column], *values: Column) -> Column:
    """use(*values), each value computed once a row.

    An expression named inside a lambda is computed again for every element; bound like
    this it is a lambda variable, which costs nothing to read.
    """
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(bound), lambda s: use(*[s[f"v{i}"] for i in range(len(values))]))[0]
