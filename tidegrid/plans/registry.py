"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, str]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    """A named SQL fragment; ``needs`` lists the fragments it reads."""
    CTES[name] = (tuple(needs.split()), sql)


def with_ctes(needs: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTES[n][0]:
            visit(m)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]},\n{body[15:]}"
    return f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"


def query(name: str, oracle: str | None = None, needs: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            CHECKS[name] = (needs, oracle.strip())
        return fn

    return add


def resolved_checks() -> dict[str, str]:
    """The SQL of every query that has one, with its fragments put in front."""
    return {name: with_ctes(needs, body) for name, (needs, body) in CHECKS.items()}
