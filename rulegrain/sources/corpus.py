"""The corpus table (repo, path, length, content) and what a scan reads of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

CORPUS_SCHEMA = "repo string, path string, length bigint, content binary"


def with_kind(corpus: DataFrame) -> DataFrame:
    """Add the storage group; write the corpus partitioned by it and scans skip foreign groups."""
    return corpus.withColumn("kind", paths.file_kind(F.col("path")))


def of_kinds(corpus: DataFrame, *kinds: str) -> DataFrame:
    """Restrict a corpus that carries its storage group; one without is returned as it is."""
    return corpus.where(F.col("kind").isin(*kinds)) if "kind" in corpus.columns else corpus


def corpus_inventory(corpus: DataFrame) -> DataFrame:
    """All files without their content; the content column is never read."""
    return corpus.select("repo", "path", F.col("length").cast("bigint").alias("length"))


def prune_ignored_dirs(files: DataFrame) -> DataFrame:
    return files.where(~paths.in_pruned_dir(F.col("path")))


def size_cap(files: DataFrame, limit: int = paths.MAX_FILE_BYTES) -> DataFrame:
    return files.where(F.col("length") <= limit)


def dispatch_column() -> Column:
    return paths.scanners_for(F.col("path"))


def scanner_dispatch(files: DataFrame) -> DataFrame:
    """One row per file and scanner that reads it."""
    return files.select("repo", "path", F.posexplode(dispatch_column()).alias("scanner_no", "scanner"))


def scannable(corpus: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Files a scan opens: outside pruned directories, small enough, and read by some scanner.

    All three tests need path and length only, so content is read for surviving files alone.
    """
    return size_cap(prune_ignored_dirs(corpus), max_bytes).where(F.size(dispatch_column()) > 0)


def too_large(files: DataFrame, max_bytes: int) -> DataFrame:
    """Error rows of files (repo, path, length) over the limit."""
    error = F.concat(F.lit("not read: "), F.col("length").cast("string"), F.lit(f" bytes, over the limit of {max_bytes}"))
    return files.select("repo", F.col("path").alias("file_path"), error.alias("error"))


def oversized_files(corpus: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Error rows for files that some scanner would read but for their size."""
    return too_large(prune_ignored_dirs(corpus).where((F.col("length") > max_bytes) & (F.size(dispatch_column()) > 0)), max_bytes)


def scanned_files(corpus: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Files opened per repository."""
    return scannable(corpus, max_bytes).groupBy("repo").agg(F.count("*").alias("scanned_files"))
