"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = (
    "beamline.plans.takeoff",
    "beamline.plans.catalog",
    "beamline.plans.records",
    "beamline.plans.layout",
    "beamline.plans.learning",
    "beamline.plans.more",
    "beamline.plans.decisions",
    "beamline.plans.matching",
    "beamline.plans.evidence",
    "beamline.plans.rules",
    "beamline.plans.drawing",
    "beamline.plans.readings",
    "beamline.plans.profiles",
    "beamline.plans.patterns",
    "beamline.plans.inference",
    "beamline.plans.sheets",
    "beamline.plans.retrieval",
    "beamline.plans.tracing",
    "beamline.plans.annotations",
    "beamline.plans.exports",
    "beamline.streaming.events",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the DuckDB SQL that gives its rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def load() -> None:
    for module in MODULES:
        import_module(module)
