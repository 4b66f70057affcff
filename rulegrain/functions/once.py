"""Values that are computed once although several expressions use them.

Catalyst copies an expression into each place that refers to it, inside a projection and, when
projections are merged or filters pushed down, across them. For a whole file's text that would
repeat the work many times over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value held in a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, over which expressions are not copied."""
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(one))
