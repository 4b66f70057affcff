"""Which rows of a large table may have a key of another one: a filter that is sized in bytes.

A join on a key of few rows shuffles the whole of a table with texts. A blocked Bloom filter of the keys
is small enough to meet the table where it is read: each key sets a few bits of one block, the blocks are
a table of (block, words) that is broadcast, and a row that lacks a bit of its block goes at once. The
exact join that follows moves what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key, bits that a key sets, and bits of a block.
BITS_PER_KEY, PROBES, BLOCK_BITS = 16, 4, 4096
#: Largest filter that is broadcast; beyond it the exact join works alone.
FILTER_BYTES = 64_000_000
_WORDS = BLOCK_BITS // 64
_ROW_BYTES = _WORDS * 8 + 32


def _block(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks))


def _bits(keys: list[Column]) -> list[Column]:
    other = F.xxhash64(*keys, F.lit("bits"))
    return [F.shiftrightunsigned(other, 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]


def filter_blocks(keys: DataFrame, columns: list[str], limit: int = FILTER_BYTES) -> tuple[DataFrame, int] | None:
    """(block, words) and the number of blocks for the distinct keys; None where the filter would exceed ``limit`` bytes.

    The keys are counted first; they should be stored, as they are read again.
    """
    named = [F.col(f"`{c}`") for c in columns]
    count = keys.select(*named).distinct().count()
    blocks = max(1, -(-count * BITS_PER_KEY // BLOCK_BITS))
    if blocks * _ROW_BYTES > limit:
        return None
    places = keys.select(_block(named, blocks).alias("block"), F.explode(F.array(*_bits(named))).alias("bit"))
    words = places.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")
    )
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0).cast("long")))
    return held.select("block", full.alias("words")), blocks


def may_be_in(facts: DataFrame, keys: DataFrame, columns: list[str], limit: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``facts`` whose key is in ``keys``, and few others; no row of ``facts`` is shuffled."""
    found = filter_blocks(keys, columns, limit)
    if found is None:
        return facts
    blocks, number = found
    named = [F.col(f"`{c}`") for c in columns]
    held = facts.withColumn("_block", _block(named, number)).join(
        F.broadcast(blocks.withColumnsRenamed({"block": "_block", "words": "_words"})), "_block"
    )
    set_ = F.lit(True)
    for bit in _bits(named):
        word = F.get(F.col("_words"), F.shiftright(bit, 6).cast("int"))
        set_ = set_ & (F.expr("1L") == F.call_function("shiftrightunsigned", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")))
    return held.where(set_).select(*[F.col(f"`{c}`") for c in facts.columns])


def only_members(facts: DataFrame, keys: DataFrame, columns: list[str], limit: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``facts`` whose key is in ``keys`` (stored), exactly."""
    named = keys.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in columns]).distinct()
    left = may_be_in(facts, keys, columns, limit)
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"`{c}`") == F.col(f"`_{c}`"))
    # an inner join on distinct keys: a semi join would be moved below the filter
    return left.join(named, same).select(*[F.col(f"`{c}`") for c in facts.columns])
