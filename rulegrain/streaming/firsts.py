"""State of the first finding per key and span of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.findings import DEDUPE_KEYS

#: What comes first: smaller values of these.
ORDER = ["root_ordinal", "ordinal"]


def fold_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch one row per key and span: the first, with the number of rows it stands for."""
    keys = [*DEDUPE_KEYS, "span"]
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.append_column("row", pa.array(range(table.num_rows), pa.int64()))
        order = table.sort_by([(c, "ascending") for c in [*keys, *ORDER, "row"]])
        firsts = order.group_by(keys, use_threads=False).aggregate([("row", "first"), ("row", "count")])
        taken = batch.take(firsts.column("row_first").combine_chunks())
        copies = firsts.column("row_count").combine_chunks().cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*taken.columns, copies], [*batch.schema.names, "copies"])


class FirstOfSpan(StatefulProcessor):
    """Holds the first row of a key and span until the watermark passes the span's end; later rows are late."""

    def __init__(self, columns: list[str], schema: str, width: int) -> None:
        self.columns, self.schema, self.width = columns, schema, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.schema)

    def _row(self, values: tuple, copies: int, late: bool) -> Row:
        return Row(*self.columns, "copies", "late")(*values, copies, late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        end = key[-1] + self.width
        if end <= timerValues.getCurrentWatermarkInMs():
            for row in rows:
                yield self._row(tuple(row[c] for c in self.columns), row["copies"], True)
            return
        rank = [self.columns.index(c) for c in ORDER]
        place = lambda values: tuple((values[i] is None, values[i]) for i in rank)
        held = self.first.get()
        best, copies = (tuple(held[: len(self.columns)]), held[len(self.columns)]) if held is not None else (None, 0)
        for row in rows:
            values = tuple(row[c] for c in self.columns)
            copies += row["copies"]
            if best is None or place(values) < place(best):
                best = values
        self.first.update((*best, copies, False))
        if held is None:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.first.get()
        self.first.clear()
        if held is not None:
            yield self._row(tuple(held[: len(self.columns)]), held[len(self.columns)], False)

    def close(self) -> None:
        pass
