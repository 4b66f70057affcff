"""Global ranks without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import stored

#: Bits of a row's number below those of its partition in monotonically_increasing_id.
_ROW_BITS = 33


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in an order that settles all ties.

    One pass deals the rows by range, sorts each partition and stores it; a row's rank is its number
    there and what the partitions before it hold. Only one count per partition is added up in one place.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(dealt.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    found = held.join(F.broadcast(before), "_part")  # one row per partition of the sort
    return found.withColumn(name, F.col("_before") + number + 1).drop("_id", "_part", "_before")
