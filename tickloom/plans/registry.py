"""Named queries, each with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    ids: str
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None) -> Callable[[Run], Run]:
    """Register ``run(spark, folder)`` under ``name`` for inventory ``ids``."""

    def wrap(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, ids, oracle)
        return run

    return wrap
