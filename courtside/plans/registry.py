"""Registered queries: name -> Spark query, name -> comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import League

_QUERIES: dict[str, Callable[[League], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the bound tables under a name."""

    def register(build: Callable[[League], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"registered twice: {name}")
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return register


def _load() -> None:
    from . import (  # noqa: F401
        on_functions, on_rollups, on_lists, on_quality, on_sources, on_resolution, on_merges, on_pages, on_questions,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {
        name: (lambda spark, folder, build=build: build(League(spark, folder)))
        for name, build in _QUERIES.items()
    }


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
