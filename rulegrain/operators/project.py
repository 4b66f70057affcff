"""Environment files that are committed, or that no ignore line covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.text import NEWLINES, lenient_text, py_strip
from ..schema import as_findings, ordinal
from ..sources.corpus import of_kinds
from .globs import ignored_files
from .lines import code_lines


def _project_files(corpus: DataFrame) -> DataFrame:
    return corpus.where(~paths.in_pruned_dir(F.col("path"), paths.PROJECT_PRUNED))


def env_files(corpus: DataFrame) -> DataFrame:
    """Files named like environment files with secrets; templates are left out."""
    return _project_files(corpus).where(paths.is_secret_env_name(paths.basename(F.col("path")))).select("repo", "path")


def gitignore_patterns(corpus: DataFrame) -> DataFrame:
    """Ignore lines of all .gitignore files of a repository, without comments and negations."""
    files = _project_files(of_kinds(corpus, "gitignore")).where(paths.basename(F.col("path")) == ".gitignore")
    texts = files.select("repo", lenient_text(F.col("content")).alias("text"))
    lines = code_lines(texts, ends=NEWLINES).select("repo", py_strip(F.col("text")).alias("text"))
    kept = lines.where((F.col("text") != "") & ~F.substring("text", 1, 1).isin("#", "!"))
    return kept.select("repo", F.rtrim("text", F.lit("/")).alias("pattern"))


def split_tracked(env: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Environment files inside and outside the index (repo, path); unknown counts as outside."""
    index = tracked.select("repo", "path").distinct()
    return env.join(index, ["repo", "path"], "left_semi"), env.join(index, ["repo", "path"], "left_anti")


def not_ignored(env: DataFrame, patterns: DataFrame) -> DataFrame:
    return env.join(ignored_files(env, patterns), ["repo", "path"], "left_anti")


def project_findings(marked: DataFrame) -> DataFrame:
    """Findings of environment files (repo, path) marked as ``committed`` and ``covered`` by an ignore line."""
    path = F.col("path")
    rule = F.when(F.col("committed"), "PRJ002").when(~F.col("covered"), "PRJ001")
    found = marked.withColumn("rule_id", rule).where(F.col("rule_id").isNotNull())

    def either(committed: Column, exposed: Column) -> Column:
        return F.when(F.col("rule_id") == "PRJ002", committed).otherwise(exposed)

    return as_findings(
        found.select(
            "repo",
            "rule_id",
            either(F.lit("CRITICAL"), F.lit("HIGH")).alias("severity"),
            F.concat(F.lit("Secret file "), path, either(F.lit(" is committed."), F.lit(" is not ignored."))).alias("message"),
            path.alias("file_path"),
            F.lit("CWE-538").alias("cwe"),
            F.lit("project").alias("category"),
            either(
                F.lit("Remove the file from the index and rotate its secrets."),
                F.concat(F.lit("Add "), paths.basename(path), F.lit(" to .gitignore.")),
            ).alias("remediation"),
            ordinal("project", F.lit(0)).alias("ordinal"),
        )
    )


def mark_env_files(env: DataFrame, tracked: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each environment file with whether the index holds it and whether an ignore line covers it: two joins."""
    index = tracked.select("repo", "path").distinct().withColumn("committed", F.lit(True))
    ignored = ignored_files(env, patterns).withColumn("covered", F.lit(True))
    joined = env.join(index, ["repo", "path"], "left").join(ignored, ["repo", "path"], "left")
    return joined.select("repo", "path", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("committed", "covered")])


def scan_project(corpus: DataFrame, tracked: DataFrame) -> DataFrame:
    return project_findings(mark_env_files(env_files(corpus), tracked, gitignore_patterns(corpus)))
