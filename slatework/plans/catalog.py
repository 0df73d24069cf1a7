"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from . import (change_queries, check_queries, function_queries, list_queries, read_queries, state_queries,  # noqa: F401
               stream_queries)
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
