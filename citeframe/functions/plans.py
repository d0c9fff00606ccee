"""Two small tools for keeping costly expressions from being evaluated twice.

The optimizer may copy a computed column into the filter or the lambda that
reads it. For a pattern search over a page that copy is the whole cost.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, also when `use` holds a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(values: str) -> Column:
    """The sum of each element and all before it, of an integer array given as SQL. Longer
    arrays take n log n additions: step k adds the value 2 ** k places to the left. A fold
    that appends to its result would copy it at every element. (As SQL, since building the
    31 steps call by call takes seconds.)"""
    steps = "a"
    for k in range(31):  # an array holds fewer than 2 ** 31 elements
        moved = f"transform(a{k}, (x, i) -> x + if(i >= {1 << k}, a{k}[i - {1 << k}], 0))"
        steps = f"transform(array({steps}), a{k} -> if(size(a{k}) > {1 << k}, {moved}, a{k}))[0]"
    short = "transform(a, (_, i) -> aggregate(slice(a, 1, i + 1), 0, (sum, x) -> sum + x))"
    return F.expr(f"transform(array({values}), a -> if(size(a) <= 24, {short}, {steps}))[0]")


def explode_computed(df: DataFrame, items: str, out: str, pos: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per element of a computed array column. A plain explode would make
    the optimizer test the array for emptiness first, computing it a second time
    (inside lambdas, once per element); the outer form with a null filter does not."""
    columns = keep if keep is not None else [c for c in df.columns if c != items]
    generated = F.posexplode_outer(items).alias(pos, out) if pos else F.explode_outer(items).alias(out)
    return df.select(*columns, generated).filter(F.col(out).isNotNull())


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filters on computed columns without moving the filter below the projection
    that computes them (a row id makes that projection non-movable)."""
    return (
        df.withColumn("_row", F.monotonically_increasing_id())
        .filter(condition & (F.col("_row") >= 0))
        .drop("_row")
    )
