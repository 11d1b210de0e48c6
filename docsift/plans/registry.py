"""Query registry: each registered query is a Spark builder plus, where SQL can
express it, an independent DuckDB oracle over the same driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    survey_id: str
    build: Builder
    oracle: str | None


_REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, survey_id: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        _REGISTRY[name] = QuerySpec(name, survey_id, fn, oracle)
        return fn

    return deco


def registry() -> dict[str, QuerySpec]:
    from docsift.plans import catalog  # noqa: F401  (imports register the queries)

    return dict(_REGISTRY)
