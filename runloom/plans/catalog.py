"""Query catalog: every registered query is a Spark plan over the given tables plus, where the
operator is expressible in SQL, the equivalent DuckDB SQL used as an oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPS: dict[str, str] = {}


def shipped(fn: QueryFn) -> QueryFn:
    """The query, with the package sent to the Python workers first: they need not have it on their path."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def query(name: str, ops: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = shipped(fn)
        OPS[name] = ops
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Doubles are compared rounded to 6 decimals (sums differ in the last bits by order)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q6(c: Column | str) -> Column:
    """6-decimal rounding by IEEE arithmetic (floor(x*1e6 + 0.5) / 1e6) so that Spark and SQL give the
    same double even where the shortest decimal form of x ends exactly in a 5."""
    x = F.col(c) if isinstance(c, str) else c
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def sql_q6(expr: str) -> str:
    return f"(floor(({expr}) * 1000000.0 + 0.5) / 1000000.0)"


def load_all() -> None:
    # importing the modules registers their queries
    from runloom.plans import (q_corpus, q_formats, q_registry, q_sources, q_streams,  # noqa: F401
                               q_telemetry, q_tokens)
