"""Accepting and rejecting rows: checks become one array of error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plans import filter_computed


def error_list(checks: dict[str, Column]) -> Column:
    """Messages of the checks that fail. A check is a condition that must be true;
    null counts as failed."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks.items()])
    )


def accepted(df: DataFrame) -> DataFrame:
    """Rows without errors. The check is computed once, not copied into the filter."""
    return filter_computed(df, F.size("errors") == 0).drop("errors")


def rejected(df: DataFrame) -> DataFrame:
    return filter_computed(df, F.size("errors") > 0)
