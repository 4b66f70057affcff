"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.ship import ship_package

#: Bytes of text one Arrow batch is worked on at a time.
SLICE_BYTES = 4_000_000


#: Bytes of rows that Spark hands to a Python worker at a time, at most.
BATCH_BYTES = 8_000_000


def prepare_workers(spark: SparkSession) -> None:
    """What a stage with Python code needs: the package on the workers, and batches of bounded bytes.

    Spark's own bound of 64 MB for a batch is held several times over, on both sides of the pipe and for
    each task of an executor. Texts are long, so the session's bound is lowered, never raised.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower()
    units = {"k": 2**10, "m": 2**20, "g": 2**30}
    digits, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", now).groups()
    if not 0 < int(digits) * units.get(unit, 1) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


#: What one operator keeps in a worker from task to task, under a key that names it.
_HELD: dict[str, object] = {}


def held_by_worker(key: str, make: Callable[[], object]) -> object:
    """A table that tasks of one worker share; a worker holds those of one key at a time.

    What earlier operators left goes back to the system before a new table is made.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def from_scratch(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A step over batches that starts without what earlier operators left in the worker, and gives its memory back.

    Workers live on from stage to stage, and what they have freed stays theirs unless it is returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()
        yield from step(batches)
        give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def crc_of_id(column: str) -> Column:
    """CRC-32 of a column as text; null counts as empty text."""
    return F.crc32(F.coalesce(quoted(column).cast("string"), F.lit("")).cast("binary"))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The frame's columns but for those that an operator's own columns of the same name replace."""
    gone = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in gone]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces that hold about ``limit`` bytes of a text column, at least one row each."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        start, held = 0, 0
        for i, size in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


class Bitmap:
    """Which of evenly spread 64-bit keys may be in a table: all that are, and few others.

    Its size follows the number of keys between 16 KB and 16 MB; beyond that it lets more others
    through, which costs time only. The map is built by an aggregate and broadcast.
    """

    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has one bigint column."""
        keys = keys.toDF("key").where("key IS NOT NULL")
        self.bits = 1 << min(27, max(17, (max(1, keys.count()) * 16).bit_length()))
        place = F.col("key").bitwiseAND(F.lit(self.bits - 1))
        bit = F.expr("shiftleft(1L, cast(key & 31 AS int))")
        found = keys.select(F.shiftright(place, 5).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        rows = found.toArrow()
        words = np.zeros(self.bits // 32, np.uint32)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
        self.held = keys.sparkSession.sparkContext.broadcast(words)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "held": self.held}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """For signed 64-bit keys, in a task."""
        place = keys & (self.bits - 1)
        return (self.held.value[place >> 5] >> (keys & 31).astype(np.uint32) & 1).astype(bool)
