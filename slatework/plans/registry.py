"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Fixtures, oracle_with

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
# name -> (fn(fixtures) -> DataFrame, fixtures it reads)
BODIES: dict[str, tuple[Callable[[Fixtures], DataFrame], tuple[str, ...]]] = {}

# Fixed inputs of the test queries (not of the operators).
AS_OF = "1999-01-01"
AS_OF_TS = "1999-01-01 00:00:00"
MONTH = "1997-06"


def register(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(fx) -> DataFrame`` under ``name``.

    ``sql`` is the oracle's final SELECT; ``uses`` lists the fixtures it
    needs, which are prepended as CTEs.
    """

    def deco(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        BODIES[name] = (fn, tuple(uses))
        if sql is not None:
            text = sql.strip()
            head = oracle_with(*uses) if uses else ""
            if uses and text[:15].lower() == "with recursive ":
                head = "WITH RECURSIVE " + head[5:]
                text = ",\n" + text[15:]
            elif uses and text[:5].lower() == "with ":
                text = ",\n" + text[5:]
            else:
                text = "\n" + text
            ORACLE[name] = head + text
        return fn

    return deco
