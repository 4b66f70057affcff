"""Files below a table of roots: an interval join on sorted paths.

Sorted by its segments, a path is followed by all that lies below it, so a root is the interval that
begins with it, and roots nest. One sweep with a stack finds every root of every file. Files are dealt
by range, and what is open where a range begins are the roots above its first path alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..sources.ship import ship_package
from ..sources.tables import stored


def clean_root(root: Column) -> Column:
    """A root as paths of files begin: without ``./``, and ``''`` for the whole tree."""
    return F.rtrim(F.regexp_replace(root, r"^(\./)+|^\.$", ""), F.lit("/"))


def _key(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def _sweep(columns: list[str]):
    """Of rows in order: each file once for every open root and every place of that root in the list."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            parts, kinds = batch.column("part").to_pylist(), batch.column("kind").to_pylist()
            names, lists = batch.column("path").to_pylist(), batch.column("ordinals").to_pylist()
            taken, roots, ordinals = [], [], []
            for i, (here, kind, path) in enumerate(zip(parts, kinds, names)):
                if here != part:
                    part, stack = here, []
                while stack and not (path == stack[-1][0] or stack[-1][0] == "" or path.startswith(stack[-1][0] + "/")):
                    stack.pop()
                if kind < 2:
                    stack.append((path, lists[i]))
                    continue
                for root, places in stack:
                    for place in places:
                        taken.append(i)
                        roots.append(root)
                        ordinals.append(place)
            kept = batch.select(columns).take(pa.array(taken, pa.int64()))
            arrays = [*kept.columns, pa.array(roots, pa.string()), pa.array(ordinals, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "root", "root_ordinal"])

    return swept


def under_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` (repo, path, ...) under each root (root, root_ordinal): their columns, root and root_ordinal.

    A file under several roots, or under one that is listed several times, has a row for each. Pass
    slim rows: they are sorted. Null paths and null roots are under nothing.
    """
    spark = files.sparkSession
    ship_package(spark)
    columns = files.columns
    listed = stored(
        roots.where("root IS NOT NULL").groupBy(clean_root(F.col("root")).alias("path")).agg(
            F.sort_array(F.collect_list(F.col("root_ordinal").cast("long"))).alias("ordinals")
        )
    )
    none = [F.lit(None).cast(kind).alias(name) for name, kind in files.dtypes if name != "path"]
    opening = listed.select("path", *none, F.lit(1).alias("kind"), "ordinals")
    rows = files.where("path IS NOT NULL").select("*", F.lit(2).alias("kind"), F.lit(None).cast("array<bigint>").alias("ordinals"))
    rows = rows.unionByName(opening).withColumn("key", _key(F.col("path")))
    # files of one path in many repositories are no single value of the order
    order = ["key", "kind", "repo"]
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    heads = dealt.groupBy("part").agg(F.min(F.struct("key", "kind", "path")).alias("head"))
    above = heads.select("part", "head", F.explode(paths.path_lineage(F.col("head.path"))).alias("path"))
    above = above.where((F.col("path") != F.col("head.path")) | (F.col("head.kind") == 2))
    open_ = above.join(listed, "path").select("part", "path", "ordinals", _key(F.col("path")).alias("key"), F.lit(0).alias("kind"), *none)
    ordered = dealt.unionByName(open_).repartition("part").sortWithinPartitions("part", F.col("kind") > 0, *order)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*files.dtypes, ("root", "string"), ("root_ordinal", "bigint")])
    return ordered.select(*columns, "kind", "ordinals", "part").mapInArrow(_sweep(columns), schema)


def below_root() -> Column:
    """The path as seen from its root; a root that is a file is seen as ``''``."""
    return F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substr(path, length(root) + 2)"))


def opened(rooted: DataFrame) -> DataFrame:
    """Rows of under_roots that a scan of the root reads, whatever their size.

    Pruned directories count only below the root, and a root that is a file is read wherever it lies.
    """
    wanted = (F.col("path") == F.col("root")) | ~paths.in_pruned_dir(below_root())
    return rooted.where(wanted & (F.size(paths.scanners_for(F.col("path"))) > 0))


def missing_roots(rooted: DataFrame, roots: DataFrame) -> DataFrame:
    """Error rows for roots under which there is no file, in any repository."""
    present = rooted.select(F.col("root").alias("clean")).distinct()
    gone = roots.where("root IS NOT NULL").withColumn("clean", clean_root(F.col("root"))).join(present, "clean", "left_anti")
    return gone.select(
        F.lit("").alias("repo"), F.col("root").alias("file_path"), F.concat(F.lit("path not found: "), F.col("root")).alias("error")
    )


_BETWEEN = "\0"


def scoped(repo: str = "repo") -> Column:
    """A repository as one root sees it; no path and no name of a repository holds the separator."""
    return F.concat_ws(_BETWEEN, F.col("root_ordinal").cast("string"), F.col("root"), F.col(repo))


def unscoped(rows: DataFrame) -> DataFrame:
    """repo, root and root_ordinal of rows whose repo was scoped."""
    parts = F.split("repo", r"\x00")
    return rows.withColumns({"root_ordinal": F.get(parts, F.lit(0)).cast("long"), "root": F.get(parts, F.lit(1)), "repo": F.get(parts, F.lit(2))})
