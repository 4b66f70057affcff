"""Findings from a table of advisory-feed replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.advisories import REPLY_SCHEMA, advisory_severity, advisory_summary, first_fixed
from ..schema import as_findings, ordinal
from .joins import lookup_join

KEY = ["ecosystem", "name", "version"]


def osv_feed(replies: DataFrame) -> DataFrame:
    """One row per advisory of each reply (ecosystem, name, version, body)."""
    parsed = replies.withColumn("reply", F.from_json("body", REPLY_SCHEMA))
    rows = parsed.select(*KEY, F.posexplode("reply.vulns").alias("vuln_no", "v"))
    return rows.select(
        *KEY,
        F.col("vuln_no").cast("int").alias("vuln_no"),
        F.coalesce(F.col("v.id"), F.lit("OSV-UNKNOWN")).alias("id"),
        advisory_severity(F.col("v.database_specific.severity"), F.col("v.severity")).alias("severity"),
        advisory_summary(F.col("v.summary"), F.col("v.details")).alias("summary"),
        first_fixed(F.col("v.affected"), F.col("name")).alias("fixed"),
    )


def first_dependencies(deps: DataFrame, scope: list[str]) -> DataFrame:
    """First manifest row of each package version; map-side combined, so a popular one is cheap."""
    first = F.min(F.struct("path", "position", "line", "repo")).alias("first")
    keys = list(dict.fromkeys([*scope, *KEY]))
    got = deps.groupBy(*keys).agg(first)
    repo = "repo" if "repo" in keys else F.col("first.repo").alias("repo")
    return got.select(*KEY, repo, "first.path", "first.position", "first.line")


def match_feed(deps: DataFrame, feed: DataFrame) -> DataFrame:
    """Each dependency row with every advisory its reply lists."""
    spread = [F.col("repo"), F.col("path"), F.col("position")]
    return lookup_join(deps.select("repo", "path", "position", "line", *KEY), feed, KEY, "inner", spread)


def osv_findings(matches: DataFrame) -> DataFrame:
    name, version, fixed = F.col("name"), F.col("version"), F.col("fixed")
    remedy = F.when(F.coalesce(fixed, F.lit("")) != "", F.concat(F.lit("Upgrade "), name, F.lit(" to >= "), fixed, F.lit(".")))
    see = F.concat(F.lit("Upgrade "), name, F.lit("; see advisory "), F.col("id"))
    return as_findings(
        matches.select(
            "repo",
            F.col("id").alias("rule_id"),
            "severity",
            F.concat(name, F.lit(" "), version, F.lit(" falls under a published advisory. "), F.col("summary")).alias("message"),
            F.col("path").alias("file_path"),
            "line",
            F.concat(name, F.lit("=="), version).alias("snippet"),
            F.lit("dependency").alias("category"),
            fixed.isNotNull().alias("fixable"),
            F.coalesce(remedy, see).alias("remediation"),
            ordinal("osv", F.col("position") * 1_000_000 + F.col("vuln_no")).alias("ordinal"),
            "vuln_no",
        )
    )


def first_per_id(findings: DataFrame, scope: list[str]) -> DataFrame:
    """First finding of each advisory id in path and file order."""
    keys = [*scope, "rule_id"]
    rest = [c for c in findings.columns if c not in keys]
    order = F.struct("file_path", "ordinal", "snippet")
    best = findings.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("b"))
    return best.select(*keys, "b.*").select(*findings.columns)


def scan_osv(
    deps: DataFrame, replies: DataFrame, offline: DataFrame, scope: tuple[str, ...] = ("repo",)
) -> DataFrame:
    """Feed findings the offline advisories did not report, each id once per scope (a scan)."""
    scope = list(scope)
    matched = osv_findings(match_feed(first_dependencies(deps, scope), osv_feed(replies)))
    known = offline.where(F.col("category") == "dependency").select(*scope, "rule_id").distinct()
    return first_per_id(matched, scope).join(known, [*scope, "rule_id"], "left_anti").select(*matched.columns)
