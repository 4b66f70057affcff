"""The algebra of findings: union, suppression, deduplication, counts, gate and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..schema import SEVERITY_RANKS, severity_rank
from ..sources.tables import constant_table
from .globs import suppressed_files
from .joins import lookup_join
from .ranks import ranked
from .roots import missing_roots as without_files, opened, under_roots

DEDUPE_KEYS = ["rule_id", "file_path", "line", "column"]


def union_scanners(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def suppress(findings: DataFrame, rules: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """Drop findings by rule or path with one config for the whole scan: a plain filter."""
    keep = F.lit(True)
    if rules:
        keep = keep & ~F.col("rule_id").isin(list(rules))
    for glob in globs:
        keep = keep & ~paths.path_glob(F.col("file_path"), F.lit(glob))
    return findings.where(keep)


def suppress_by_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop findings whose (repo, rule_id) is listed; one rule may hold most findings of a repository."""
    listed = rules.select("repo", "rule_id").distinct()
    spread = [F.col("file_path"), F.col("line")]
    return lookup_join(findings, listed, ["repo", "rule_id"], "left_anti", spread).select(*findings.columns)


def suppress_by_path(findings: DataFrame, globs: DataFrame) -> DataFrame:
    """Drop findings under a suppressed path of their repository; globs is (repo, pattern).

    Patterns meet distinct paths, not findings, and only those of a shared key. One file holds few
    findings beside the table, so the join on files needs no salt.
    """
    files = findings.select("repo", F.col("file_path").alias("path")).distinct()
    covered = suppressed_files(files, globs).withColumnRenamed("path", "file_path")
    return findings.join(covered, ["repo", "file_path"], "left_anti").select(*findings.columns)


def suppress_with_tables(findings: DataFrame, rules: DataFrame, globs: DataFrame) -> DataFrame:
    return suppress_by_path(suppress_by_rule(findings, rules), globs)


def suppression_tables(config: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Config rows (repo, ignore_rules, ignore_paths, fail_on) as rule, path and threshold tables."""
    rules = config.select("repo", F.explode("ignore_rules").alias("rule_id"))
    globs = config.select("repo", F.explode("ignore_paths").alias("pattern"))
    gates = config.select("repo", F.upper("fail_on").alias("fail_on")).where("fail_on is not null and fail_on != ''")
    return rules, globs, gates


def dedupe_findings(findings: DataFrame, keys: list[str] = DEDUPE_KEYS) -> DataFrame:
    """First finding per key over roots in order; needs ``root_ordinal`` beside ``ordinal``.

    An aggregate rather than a window: copies of one key are reduced on the map side, so a key that
    holds a large share of the rows sends one row per task.
    """
    rest = [c for c in findings.columns if c not in keys]
    order = F.struct("root_ordinal", "ordinal", "snippet")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("first")
    best = findings.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first)
    return best.select(*[F.col(f"`{k}`") for k in keys], "first.*").select(*[F.col(f"`{c}`") for c in findings.columns])


def files_under(inventory: DataFrame, roots: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Files (repo, path, length) a scan of the roots opens, once for each root."""
    named = inventory if "repo" in inventory.columns else inventory.withColumn("repo", F.lit(""))
    return opened(under_roots(named.select("repo", "path", "length"), roots)).where(F.col("length") <= max_bytes)


def scan_totals(inventory: DataFrame, roots: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    """Files opened over all roots; a file under several roots counts once for each."""
    return files_under(inventory, roots, max_bytes).agg(F.count("*").alias("scanned_files"))


def merge_roots(findings: DataFrame, roots: DataFrame, keys: list[str] = DEDUPE_KEYS) -> DataFrame:
    """Findings of every root in order, those seen before left out.

    A finding is first seen under the first root of its file, so distinct files alone are sorted.
    """
    files = findings.select("repo", F.col("file_path").alias("path")).distinct()
    first = under_roots(files, roots).groupBy("repo", F.col("path").alias("file_path")).agg(F.min("root_ordinal").alias("root_ordinal"))
    rooted = findings.join(first, ["repo", "file_path"]).select(*findings.columns, "root_ordinal")
    return dedupe_findings(rooted, keys).drop("root_ordinal")


def missing_roots(corpus: DataFrame, roots: DataFrame) -> DataFrame:
    """Error rows for roots under which there is no file."""
    named = corpus if "repo" in corpus.columns else corpus.withColumn("repo", F.lit(""))
    return without_files(under_roots(named.select("repo", "path"), roots), roots)


def sort_columns() -> list[Column]:
    """Most severe first, then file, line and rule; the rest settles ties."""
    return [
        F.col("severity_rank").desc(), F.col("file_path"), F.col("line"), F.col("rule_id"),
        F.col("column"), F.col("ordinal"), F.col("repo"),
    ]


def sorted_findings(findings: DataFrame) -> DataFrame:
    """All findings in report order.

    A range sort samples its input before it sorts, which reads it twice: store the findings of a scan first.
    """
    return findings.orderBy(*sort_columns())


def ranked_findings(findings: DataFrame) -> DataFrame:
    """All findings with their place in report order, from 1; the findings are read once."""
    return ranked(findings, sort_columns())


def severity_levels(spark: SparkSession) -> DataFrame:
    return constant_table(spark, {"severity": "string", "severity_rank": "int"}, list(SEVERITY_RANKS.items()))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per level, all four levels included."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    levels = severity_levels(findings.sparkSession)
    joined = levels.join(counts, "severity", "left")
    return joined.select("severity", "severity_rank", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def severity_desc(findings: DataFrame) -> DataFrame:
    return severity_counts(findings).orderBy(F.col("severity_rank").desc())


def severity_columns() -> list[Column]:
    """Counts per level as aggregate columns, for grouped summaries."""
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANKS]


def fixable_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("fixable")).alias("fixable"))


def exit_code(worst: Column, fail_on: Column) -> Column:
    """2 when the worst rank reaches the named level, else 0; an unknown or absent level never fails."""
    threshold = severity_rank(fail_on)
    return F.when(F.coalesce(worst >= threshold, F.lit(False)), 2).otherwise(0)


def gate(findings: DataFrame, fail_on: str | None, config_fail_on: str | None = None) -> DataFrame:
    """One row: worst rank and exit code. The explicit level wins over the config's."""
    level = F.lit(fail_on or config_fail_on).cast("string")
    worst = findings.agg(F.max("severity_rank").alias("worst"))
    return worst.select("worst", exit_code(F.col("worst"), level).alias("exit_code"))


def gate_by_repo(findings: DataFrame, gates: DataFrame) -> DataFrame:
    """Gate of every repository with its own level (repo, fail_on)."""
    worst = findings.groupBy("repo").agg(F.max("severity_rank").alias("worst"))
    joined = worst.join(gates, "repo", "left")
    return joined.select("repo", "worst", "fail_on", exit_code(F.col("worst"), F.col("fail_on")).alias("exit_code"))


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Findings per file and line: how many, how many fixable, the worst rank and the rules in order.

    A line's findings are bounded by the rules and the length of the line; copies of one finding are
    folded on the map side, so the list stays small whatever the table holds.
    """
    return findings.groupBy("repo", "file_path", "line").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fixable")).alias("fixable"),
        F.max("severity_rank").alias("worst"),
        F.array_join(
            F.transform(F.sort_array(F.collect_set(F.struct("ordinal", "column", "rule_id"))), lambda s: s["rule_id"]), ","
        ).alias("rules"),
    )
