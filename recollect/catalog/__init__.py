"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "text", "vectors", "lookup", "metrics", "calibration", "windows", "retention",
    "maintenance", "workload", "replication", "streams",
)


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; ``sql=None`` where no SQL can say the same."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(build, sql)
        return build

    return add


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES
