"""The registry of named queries, each a plan over the testbed and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.testbed import Bed, with_tables

_PLANS: dict[str, Callable[[Bed], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with its DuckDB counterpart."""

    def add(plan: Callable[[Bed], DataFrame]) -> Callable[[Bed], DataFrame]:
        if name in _PLANS:
            raise ValueError(f"{name} is there already")
        _PLANS[name] = plan
        if sql:
            _SQL[name] = sql
        return plan

    return add


def _load() -> None:
    for module in ("relational", "texts", "searches", "graphs", "entities"):
        import_module(f"loomgraph.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, plan=plan: plan(Bed(spark, sf_dir))) for name, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_tables(sql) for name, sql in _SQL.items()}
