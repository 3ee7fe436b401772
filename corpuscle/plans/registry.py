"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import inspect

from . import queries as _queries
from . import sql as _sql


def queries() -> dict:
    """Every public function of the queries module that takes a session and a folder."""
    return {k: f for k, f in vars(_queries).items() if inspect.isfunction(f) and not k.startswith("_") and list(inspect.signature(f).parameters) == ["spark", "sf_dir"]}


def oracle_sql() -> dict[str, str]:
    return _sql.oracle_sql()
