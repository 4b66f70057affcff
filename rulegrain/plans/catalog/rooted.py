"""Queries over scans and fixes of some roots only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import paths
from .. import derive, oracle as o
from ..scan import fix, scan
from .fixes import BUMP, PATCHED, TARGETS
from .registry import query, shown
from .rules import ALL, CODE, DEP_FINDINGS, scan_corpus

#: Folders, some inside pruned ones or inside each other, one twice, a manifest, and one that is not there.
ROOTS = ["build/", "./src", "src/core/", "node_modules/x", "svc3", "svc3/", "svc13/package.json", "gone/away", "svc4", "svc10/requirements.txt", "p4"]
#: Beside them, every tenth file that lies in a folder which a scan of the whole tree does not enter.
_SINGLE = "k % 10 = 0 AND starts_with(path, 'node_modules/left/')"

ROOTED = [
    CODE,
    *DEP_FINDINGS,
    derive.tree_sql(),
    f"""root_list AS (
      SELECT rtrim(regexp_replace(root, '^(\\./)+', ''), '/') AS root, ord, root AS given FROM (VALUES {", ".join(f"('{r}', {i})" for i, r in enumerate(ROOTS))}) AS t(root, ord)
      UNION ALL SELECT path, 100 + k, path FROM code_texts WHERE {_SINGLE})""",
    """every_file AS (
      SELECT repo, path, NULL AS text, false AS tree FROM code_texts UNION ALL SELECT repo, path, NULL, false FROM manifest_texts
      UNION ALL SELECT repo, path, NULL, true FROM env_tree UNION ALL SELECT repo, path, text, true FROM ignore_tree)""",
    """rooted AS (
      SELECT e.*, r.root, r.ord, CASE WHEN r.root = '' THEN path ELSE substr(path, length(r.root) + 2) END AS below
      FROM every_file e JOIN root_list r ON r.root = '' OR path = r.root OR starts_with(path, r.root || '/'))""",
    f"opened AS (SELECT * FROM rooted WHERE (path = root OR NOT {o.pruned('below')}) AND {o.has_scanner('path')})",
    "scanned AS (SELECT repo, path, text, ext, step FROM code_texts WHERE (repo, path) IN (SELECT (repo, path) FROM opened))",
    o.lines_cte("file_lines", "scanned"),
    o.code_findings("code_f", "file_lines"),
    o.secret_findings("sec_f", "file_lines", True),
    o.python_findings("py_f", "scanned"),
]
_PROJECT = f"""prj_f AS (
  WITH env_tree AS (SELECT root || '|' || ord || '|' || repo AS repo, below AS path FROM rooted WHERE tree AND text IS NULL AND path <> root),
  ignore_tree AS (SELECT root || '|' || ord || '|' || repo AS repo, below AS path, text FROM rooted
    WHERE text IS NOT NULL AND path <> root AND NOT {o.pruned('below', paths.PROJECT_PRUNED)}),
  {o.env_tree_ctes()}
  SELECT DISTINCT e.whole AS repo, e.full_path AS file_path, CASE WHEN t.path IS NOT NULL THEN 'PRJ002' ELSE 'PRJ001' END AS rule_id
  FROM (SELECT *, string_split(repo, '|')[3] AS whole, string_split(repo, '|')[1] || '/' || path AS full_path FROM env_files) e
  LEFT JOIN (SELECT DISTINCT repo, path FROM tracked) t ON t.repo = e.whole AND t.path = e.full_path
  WHERE t.path IS NOT NULL OR (e.repo, e.path) NOT IN (SELECT (repo, path) FROM ignored))"""
FOUND = f"""f AS (
  {ALL} code_f UNION ALL {ALL} sec_f UNION ALL {ALL} py_f UNION ALL {ALL} dep_f WHERE (repo, file_path) IN (SELECT (repo, path) FROM opened)
  UNION ALL SELECT repo, rule_id, CASE rule_id WHEN 'PRJ001' THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
    CASE rule_id WHEN 'PRJ001' THEN 3 ELSE 4 END AS severity_rank, file_path, 0 AS line, 0 AS "column", 'CWE-538' AS cwe, '' AS snippet,
    'project' AS category, false AS fixable FROM prj_f)"""


def roots(spark, sf_dir):
    fixed = spark.createDataFrame(list(zip(ROOTS, range(len(ROOTS)))), "root string, root_ordinal bigint")
    key = F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint")
    single = derive.code_texts(spark, sf_dir).where(F.startswith("path", F.lit("node_modules/left/")) & (key % 10 == 0))
    return fixed.unionByName(single.select(F.col("path").alias("root"), (key + 100).alias("root_ordinal")))


def rooted_scan(spark, sf_dir):
    return scan(scan_corpus(spark, sf_dir), derive.tracked(spark, sf_dir), roots=roots(spark, sf_dir))


@query(
    "scan_roots",
    o.with_(*ROOTED, _PROJECT, FOUND, f'{ALL} f QUALIFY row_number() OVER (PARTITION BY repo, rule_id, file_path, line, "column") = 1'),
)
def scan_roots(spark, sf_dir):
    """Roots inside pruned folders, inside each other, given twice, single files, and one that is missing."""
    return shown(rooted_scan(spark, sf_dir).findings)


@query("scan_roots_totals", o.with_(*ROOTED, "SELECT repo, count(*) AS scanned_files FROM opened GROUP BY repo"))
def scan_roots_totals(spark, sf_dir):
    return rooted_scan(spark, sf_dir).stats


@query(
    "scan_roots_errors",
    o.with_(
        *ROOTED,
        """SELECT repo, path AS file_path, 'dependency scan failed: not a table of packages' AS error
             FROM opened JOIN manifest_texts m USING (repo, path) WHERE m.text = '[1, 2]'
           UNION ALL SELECT '', given, 'path not found: ' || given FROM root_list WHERE root NOT IN (SELECT root FROM rooted)""",
    ),
)
def scan_roots_errors(spark, sf_dir):
    return rooted_scan(spark, sf_dir).errors


@query(
    "fix_roots",
    o.with_(
        *ROOTED,
        derive.configs_sql(),
        PATCHED.replace("FROM scanned WHERE ext = '.go'", "FROM scanned WHERE ext = '.go' AND (repo, 'GO004') NOT IN (SELECT (repo, unnest(ignore_rules)) FROM configs)"),
        TARGETS, BUMP,
        """SELECT repo, path, fixed, change_count FROM patched WHERE NOT starts_with(path, 'src/core/')
           UNION ALL SELECT repo, path, string_agg(coalesce(b.new_text, raw), chr(10) ORDER BY line), CAST(count(b.line) AS INTEGER)
           FROM manifest_all m LEFT JOIN bumped b USING (repo, path, line)
           WHERE (repo, path) IN (SELECT (repo, path) FROM bumped) AND (repo, path) IN (SELECT (repo, path) FROM opened) GROUP BY repo, path""",
    ),
)
def fix_roots(spark, sf_dir):
    """Code and requirements fixed in one run, but for what the scan of these roots suppresses."""
    configs = derive.configs(spark, sf_dir).where(F.array_contains("ignore_rules", "GO004"))
    configs = configs.withColumn("ignore_paths", F.array().cast("array<string>"))
    found = fix(scan_corpus(spark, sf_dir), derive.tracked(spark, sf_dir), ignore_paths=["src/core/"], config=configs, roots=roots(spark, sf_dir))
    return found.select("repo", "path", "fixed", "change_count")
