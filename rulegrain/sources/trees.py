"""A corpus from directories on a file system that every executor can see.

The file sources of Spark skip names that start with a dot, among them the very files the project check
wants. Folders are listed in rounds of Spark tasks, which hand on what they did not come to, and files
are then dealt to tasks by their bytes: neither a deep tree nor one folder with most files is one task's.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths
from .ship import ship_package
from .tables import stored

#: Entries a task lists below one folder before it hands on the folders that are left, and bytes a task reads.
ENTRIES, TASK_BYTES = 20_000, 32_000_000
#: What a file counts for beside its bytes: opening it takes time too.
_OPEN_BYTES = 16_000
_LISTED = "repo string, root string, path string, is_dir boolean, length bigint"
_ARROW = pa.schema([("repo", pa.string()), ("root", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64())])


def _entries(top: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Paths below ``top`` in a folder, whether they are folders, and their bytes; -1 where that can't be told."""
    try:
        with os.scandir(os.path.join(top, folder)) as found:
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in paths.PROJECT_PRUNED:
                        yield path, True, 0
                elif not entry.is_dir():
                    try:
                        yield path, False, entry.stat().st_size
                    except OSError:
                        yield path, False, -1
    except OSError:
        return


def _list(limit: int):
    """Entries below the folders of a batch; folders beyond the limit are left to the next round."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pending, seen, rows = [row["path"]], 0, []
                while pending:
                    folder = pending.pop()
                    if seen >= limit:
                        rows.append((folder, True, 0))
                        continue
                    for path, is_dir, size in _entries(row["root"], folder):
                        seen += 1
                        if is_dir:
                            pending.append(path)
                        else:
                            rows.append((path, False, size))
                        if len(rows) >= 10_000:
                            yield _rows(row, rows)
                            rows = []
                yield _rows(row, rows)

    return listed


def _rows(row: dict, rows: list[tuple[str, bool, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        [{"repo": row["repo"], "root": row["root"], "path": p, "is_dir": d, "length": n} for p, d, n in rows], schema=_ARROW
    )


def list_tree(spark: SparkSession, roots: dict[str, str], limit: int = ENTRIES) -> DataFrame:
    """Files (repo, root, path, length) below directories {repo: directory}; directories no check enters are left out.

    Symbolic links to directories are not followed, and folders that can't be read hold nothing.
    """
    ship_package(spark)
    folders = spark.createDataFrame([(r, os.path.abspath(d), "") for r, d in sorted(roots.items())], "repo string, root string, path string")
    tasks, files = max(1, min(len(roots), 10_000)), None
    while tasks:
        listed = stored(folders.repartition(tasks).mapInArrow(_list(limit), _LISTED))
        found = listed.where("NOT is_dir").drop("is_dir")
        files = found if files is None else files.unionByName(found)
        folders = listed.where("is_dir").select("repo", "root", "path")
        tasks = min(folders.count(), 10_000)
    return files


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file with the bytes that its partition holds before it."""
    before = 0
    for batch in batches:
        costs = np.maximum(batch.column("length").to_numpy(), 0) + _OPEN_BYTES
        ends = before + np.cumsum(costs)
        yield batch.append_column("before", pa.array(ends - costs))
        before = int(ends[-1]) if len(ends) else before


def dealt_by_bytes(files: DataFrame, max_bytes: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files in as many partitions as their bytes ask for; those over ``max_bytes`` are not read and count as empty."""
    cost = F.when(F.col("length") > max_bytes, 0).otherwise(F.col("length")).cast("bigint").alias("length")
    counted = files.select("repo", "root", "path", F.col("length").alias("size"), cost, F.spark_partition_id().alias("part"))
    schema = "repo string, root string, path string, size bigint, length bigint, part int, before bigint"
    held = stored(counted.mapInArrow(_running, schema))
    sums = held.groupBy("part").agg((F.sum(F.greatest("length", F.lit(0))) + F.count("*") * _OPEN_BYTES).alias("n"))
    ahead = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    bins = held.join(F.broadcast(ahead), "part")  # one row per partition of the listing
    number = F.floor((F.col("before") + F.col("ahead")) / task_bytes)
    return bins.select("repo", "root", "path", F.col("size").alias("length"), number.alias("bin")).repartition(max(1, -(-total // task_bytes)), "bin")


def _read(max_bytes: int):
    schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def row(file: dict) -> dict:
        size, content = max(file["length"], 0), None
        if 0 <= file["length"] <= max_bytes:
            try:
                with open(os.path.join(file["root"], file["path"]), "rb") as handle:
                    content = handle.read(max_bytes + 1)
                size = len(content)
            except OSError:
                size = 0
        return {"repo": file["repo"], "path": file["path"], "length": size, "content": content}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for file in batch.to_pylist():
                held.append(row(file))
                size += len(held[-1]["content"] or b"")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return read


def read_tree(
    spark: SparkSession, roots: dict[str, str], max_bytes: int = paths.MAX_FILE_BYTES, limit: int = ENTRIES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The corpus (repo, path, length, content) of directories {repo: directory}.

    Files over ``max_bytes`` are listed without content, and are not opened. A file that can't be read
    has no content and no length.
    """
    files = dealt_by_bytes(list_tree(spark, roots, limit), max_bytes, task_bytes)
    return files.mapInArrow(_read(max_bytes), "repo string, path string, length bigint, content binary")
