"""Registered queries: name -> plan over the given tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.canonical import CTES, Tables
from tidemark.session import apply_runtime_conf


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        return presented(self.plan(Tables(spark, sf_dir)), self.digits)


REGISTRY: dict[str, Query] = {}


def presented(df: DataFrame, digits: int) -> DataFrame:
    """Rounded doubles and plain timestamps, for comparison with another engine."""
    shown = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        shown.append(c.alias(f.name))
    return df.select(*shown)


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6, ctes: str = ""):
    """Register a plan. ``ctes`` names shared SQL inputs, ``floats`` the columns to round."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, plan, compose(sql, floats, digits, ctes) if sql else None, digits)
        return plan

    return register


def compose(sql: str, floats: str, digits: int, ctes: str) -> str:
    """The query text behind its shared inputs, with rounded floats."""
    rounded = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in floats.split())
    chosen = f"* REPLACE ({rounded})" if rounded else "*"
    body = f"SELECT {chosen} FROM (\n{sql.strip()}\n)"
    return decimal_rounding(f"WITH {', '.join(with_dependencies(ctes.split()))}\n{body}" if ctes else body)


def decimal_rounding(sql: str) -> str:
    """Give every ``round_even(x, n)`` a decimal argument, so that ties are exact ties."""
    name = "round_even("
    while name in sql:
        start = sql.rindex(name) + len(name)
        depth, comma, at = 1, 0, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            if sql[at] == "," and depth == 1:
                comma = at
            at += 1
        digits = int(sql[comma + 1 : at - 1])
        value = f"CAST({sql[start:comma]} AS DECIMAL(28, {digits + 6}))"
        sql = f"{sql[: start - len(name)]}CAST(ROUND_EVEN({value}, {digits}) AS DOUBLE){sql[at:]}"
    return sql


def with_dependencies(names: list[str]) -> list[str]:
    """Definitions of the named inputs, each after the ones it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in CTES[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    return [f"{n} AS (\n{CTES[n][1].strip()}\n)" for n in ordered]
