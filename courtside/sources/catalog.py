"""Registry of the league's tables and of the ranking metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..constants import PLAYER_METRICS, TABLES, TEAM_METRICS


def known_table(name: str) -> str:
    """The name itself, if the league has such a table."""
    if name not in TABLES:
        raise KeyError(f"table is not registered: {name}")
    return name


def sql_over(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """Run SQL over loaded tables, which the text names in braces (``FROM {games}``).

    The tables are bound for this statement alone, so the caller's session gets no views.
    """
    bound = {known_table(name): df for name, df in tables.items()}
    return next(iter(bound.values())).sparkSession.sql(text, **bound)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make loaded tables reachable from SQL under their names, for the rest of the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(known_table(name))


def first_present(candidates: Iterable[str], columns: Iterable[str]) -> str | None:
    """The first candidate that the table has."""
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def metric_column(metric: str, columns: Iterable[str], metrics: dict) -> str:
    """Column that holds a metric; raises when the metric or the column is unknown."""
    if metric not in metrics:
        raise KeyError(f"unknown metric: {metric}")
    found = first_present(metrics[metric][1], columns)
    if found is None:
        raise KeyError(f"no column for metric: {metric}")
    return found


def available_metrics(df: DataFrame, metrics: dict) -> DataFrame:
    """The metrics a table can be ranked by: key, label and the column used."""
    rows = [
        (key, label, column)
        for key, (label, candidates) in metrics.items()
        if (column := first_present(candidates, df.columns))
    ]
    return df.sparkSession.createDataFrame(rows, "key string, label string, column string")


def player_metrics(df: DataFrame) -> DataFrame:
    return available_metrics(df, PLAYER_METRICS)


def team_metrics(df: DataFrame) -> DataFrame:
    return available_metrics(df, TEAM_METRICS)
