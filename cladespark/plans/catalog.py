"""All queries over the tables of a data directory, with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from . import phylo, relational  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
