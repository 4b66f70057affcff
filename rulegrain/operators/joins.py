"""Joins against lookup tables whose size is not known in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16

# A lookup table of at most this many rows, each well under a kilobyte, is broadcast.
BROADCAST_ROWS = 50_000


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """Count no further than one row past the limit."""
    return df.limit(limit + 1).count() <= limit


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, spread: list[Column], condition=None, rows: int | None = None
) -> DataFrame:
    """Join a large table to an input table that is usually small.

    The lookup's rows are counted first, unless ``rows`` says how many there are: up to the limit it
    is broadcast and the facts stay where they are; beyond it the join is salted. Both ways give the
    same rows.
    """
    if not (rows_at_most(lookup, BROADCAST_ROWS) if rows is None else rows <= BROADCAST_ROWS):
        return salted_join(facts, lookup, keys, how, spread, condition)
    left, right = facts.alias("f"), F.broadcast(lookup).alias("l")
    joined = left.join(right, _on(keys, condition), how)
    return joined if how in ("left_semi", "left_anti") else _columns(joined, facts, lookup, keys)


def _on(keys: list[str], condition) -> Column:
    on = None
    for key in keys:
        same = F.col(f"f.{key}") == F.col(f"l.{key}")
        on = same if on is None else on & same
    return on if condition is None else on & condition("f", "l")


def _columns(joined: DataFrame, facts: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    extra = [c for c in lookup.columns if c not in keys]
    return joined.select(*[F.col(f"f.`{c}`") for c in facts.columns], *[F.col(f"l.`{c}`") for c in extra])


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str,
    spread: list[Column],
    condition=None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a smaller one on keys that may be very uneven.

    A key's fact rows are dealt over ``salts`` pieces by the hash of ``spread``; the lookup rows are
    repeated once per piece, so each fact row still meets every lookup row of its key exactly once.
    No side is hinted: where the lookup turns out to be small, adaptive execution broadcasts it.
    ``condition`` takes (facts, lookup) and returns an extra predicate.
    """
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).alias("f")
    right = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)]))).alias("l")
    joined = left.join(right, _on([*keys, "_salt"], condition), how)
    return joined.drop("_salt") if how in ("left_semi", "left_anti") else _columns(joined, facts, lookup, keys)
