"""Paths covered by glob tables: one walk per path over the patterns of its repository.

Pairing every path with every pattern of its repository would be quadratic, and listing the pieces of a path
that a pattern may be filed under makes hundreds of rows of it. Instead a repository's patterns become a trie
of segments (``tries.py``) in the task that reads its paths, and each path is one row, walked once.

Patterns whose size is checked are broadcast, and no path moves. Beyond that, patterns and paths of a repository
meet by (repo, block, salt): patterns are dealt over blocks, so that a task's trie is bounded, and paths over
salts, so that a repository with most of them is many tasks. Paths are repeated only for repositories with more
than one block. Texts are never part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.ship import ship_package
from .joins import SALTS, salted_join
from .tries import PathTrie

#: Patterns, with the names of their repositories, that are broadcast, and those of one trie beyond that, in bytes.
BROADCAST_BYTES, BLOCK_BYTES = 4_000_000, 8_000_000
#: Tries that a task keeps of broadcast patterns.
KEPT_TRIES = 256

_SCHEMA = "repo string, path string"


def _texts(column: pa.Array) -> list[str | None]:
    """As text; bytes that are none are replaced for the comparison only."""
    return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def _trie(patterns: list[str], add) -> PathTrie:
    trie = PathTrie()
    for pattern in patterns:
        add(trie, pattern)
    return trie


def _walk_held(held, add):
    """Covered rows of batches (repo, path), with all patterns at hand."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, PathTrie] = {}
        for batch in batches:
            covered = []
            for repo, path in zip(_texts(batch.column("repo")), _texts(batch.column("path"))):
                patterns = held.value.get(repo)
                if patterns and repo not in tries:
                    if len(tries) >= KEPT_TRIES:
                        tries.clear()
                    tries[repo] = _trie(patterns, add)
                covered.append(bool(patterns) and path is not None and tries[repo].covers(path))
            yield batch.filter(pa.array(covered, pa.bool_()))

    return walk


def _walk_sorted(add):
    """Covered rows of batches in order of (repo, block, salt), patterns (is_path false) before paths."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, PathTrie()
        for batch in batches:
            covered = []
            keys = zip(_texts(batch.column("repo")), *(batch.column(c).to_pylist() for c in ("block", "salt", "is_path")))
            for (*key, is_path), text in zip(keys, _texts(batch.column("path"))):
                if key != now:
                    now, trie = key, PathTrie()
                if not is_path:
                    add(trie, text)
                covered.append(is_path and trie.covers(text))
            yield batch.filter(pa.array(covered, pa.bool_())).select(["repo", "path"])

    return walk


def _dealt(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (repo, block, salt, is_path, path): patterns for each salt of their block, paths for each block."""
    size = F.sum(F.octet_length("pattern"))
    blocks = patterns.groupBy("repo").agg(F.ceil((size + 1) / BLOCK_BYTES).cast("int").alias("blocks"))
    salt = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")
    named = salted_join(patterns, blocks, ["repo"], "inner", [F.col("pattern")])
    placed = named.select(
        "repo", F.pmod(F.xxhash64("pattern"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("is_path"), F.col("pattern").alias("path"),
    )
    known = salted_join(files, blocks, ["repo"], "inner", [F.col("path")])
    paths = known.select(
        "repo", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), salt("path").alias("salt"),
        F.lit(True).alias("is_path"), "path",
    )
    return placed.unionByName(paths)


def _covered(files: DataFrame, patterns: DataFrame, add) -> DataFrame:
    """Distinct rows (repo, path) of ``files`` that a pattern covers; rows with nulls are never covered, nor cover anything."""
    spark = files.sparkSession
    files = files.select("repo", "path").where("repo IS NOT NULL AND path IS NOT NULL")
    named = patterns.select("repo", "pattern").where("repo IS NOT NULL AND pattern IS NOT NULL").distinct()
    size = named.agg(F.sum(F.octet_length("repo") + F.octet_length("pattern"))).first()[0]
    if size is None:
        return files.limit(0)
    ship_package(spark)
    if size <= BROADCAST_BYTES:
        rows, by_repo = named.toArrow(), {}
        for repo, pattern in zip(_texts(rows.column("repo")), _texts(rows.column("pattern"))):
            by_repo.setdefault(repo, []).append(pattern)
        return files.mapInArrow(_walk_held(spark.sparkContext.broadcast(by_repo), add), _SCHEMA).distinct()
    keys = ["repo", "block", "salt"]
    ordered = _dealt(files, named).repartition(*keys).sortWithinPartitions(*keys, "is_path")
    return ordered.mapInArrow(_walk_sorted(add), _SCHEMA).distinct()


def ignored_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (repo, path) covered by an ignore line of their repository."""
    return _covered(files, patterns, PathTrie.add_ignore)


def suppressed_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (repo, path) covered by a path suppression of their repository."""
    return _covered(files, patterns, PathTrie.add_suppression)
