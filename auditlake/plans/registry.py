"""Registry of named queries and their independent SQL oracles.

Each query is ``(spark, sf_dir) -> DataFrame``; its oracle is ANSI SQL that
DuckDB runs over the same driver tables. The oracle is written separately
(SQL, not derived from the DataFrame code), so a match is real evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.plans import oracle_ctes
from auditlake.session import ensure_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operators: str, oracle: str | None = None):
    """Register ``fn`` as query ``name`` covering SURVEY ids ``operators``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPERATORS[name] = operators
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


def sql(body: str, *ctes: str) -> str:
    """``WITH <ctes and their dependencies> <body>`` for DuckDB."""
    return oracle_ctes.with_ctes(body, *ctes)
