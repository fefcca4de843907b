"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.plans.views import duck_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, tuple[str, str]] = {}
CTES: dict[str, tuple[str, list[str]]] = dict(duck_views())


def query(key: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Register a query; `sql` is its twin over the named CTEs in `uses`."""

    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            TWINS[key] = (sql, uses)
        return fn

    return add


def oracles() -> dict[str, str]:
    """Complete SQL text of every twin."""
    return {key: expand_r4(with_ctes(sql, uses)) for key, (sql, uses) in TWINS.items()}


def cte(name: str, sql: str, uses: str = "") -> None:
    """Define a named SQL step for the twins."""
    CTES[name] = (sql, uses.split())


# Added before rounding on both sides, so that exact halves cannot round differently.
NUDGE = 1.7e-7


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round the double columns, so that the order of summation does not show."""
    return df.select(
        *[F.round(F.col(c) + F.lit(NUDGE), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def expand_r4(sql: str) -> str:
    """`r4(x)` stands for the rounding of `rounded`."""
    at = sql.find("r4(")
    while at >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}round(CAST({sql[at + 3 : end - 1]} AS DOUBLE) + {NUDGE}, 4){sql[end:]}"
        at = sql.find("r4(")
    return sql


def with_ctes(sql: str, uses: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in CTES:
            return
        for need in CTES[name][1]:
            visit(need)
        ordered.append(name)

    for name in uses.split():
        if name not in CTES:
            raise KeyError(name)
        visit(name)
    if not ordered:
        return sql
    steps = ",\n".join(f"{name} AS ({CTES[name][0]})" for name in ordered)
    # a recursive twin brings its own steps and continues the list
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {steps},\n{sql.lstrip()[len('WITH RECURSIVE '):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {steps},\n{sql.lstrip()[len('WITH '):]}"
    return f"WITH {steps}\n{sql}"
