"""Registered queries."""

from . import chat, data, files, pieces, scoring, sets, streams  # noqa: F401
from .registry import QUERIES, SQL, table  # noqa: F401
