"""Queries over findings tables: joins, order, counts, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.versions import parse_version
from ...operators import dependencies as deps, findings as fs, lines, osv, project
from ...operators.responses import scan_responses
from ...operators.secrets import scan_secret_lines
from ...schema import SEVERITY_RANKS
from ...sources.tables import stored
from .. import derive, oracle as o
from .registry import FINDING_COLUMNS, query, shown
from .rules import ADVISORIES, ALL, DEP_FINDINGS, DEPS, MANIFESTS, OSV, PATHS_SQL, SCAN, all_findings

LINES = derive.unique_lines_sql()
BASE = [
    LINES,
    o.code_findings("code_f", "unique_lines"),
    o.secret_findings("sec_f", "unique_lines"),
    f"f AS MATERIALIZED (SELECT {o.FINDING}, ordinal FROM code_f UNION ALL SELECT {o.FINDING}, ordinal FROM sec_f)",
]


def base_findings(spark, sf_dir):
    """Findings of all line rules on the order lines."""
    rows = derive.unique_lines(spark, sf_dir)
    return lines.scan_lines(rows).unionByName(scan_secret_lines(rows))


RULES = ["JS001", "SEC006", "GO002"]
GLOBS = ["*.java", "src/f1*", "src/f2[0-3]*.js"]


@query(
    "suppress",
    o.with_(
        *BASE,
        f"""{ALL} f WHERE rule_id NOT IN {o.in_list(RULES)} AND NOT (file_path GLOB '*.java' OR file_path GLOB 'src/f1*'
            OR file_path GLOB 'src/f2[0-3]*.js')""",
    ),
)
def suppress(spark, sf_dir):
    return shown(fs.suppress(base_findings(spark, sf_dir), RULES, GLOBS))


CONFIG = derive.configs_sql()


@query(
    "suppress_by_rule",
    o.with_(
        *BASE, CONFIG, "rules AS (SELECT repo, unnest(ignore_rules) AS rule_id FROM configs)",
        f"{ALL} f WHERE (repo, rule_id) NOT IN (SELECT (repo, rule_id) FROM rules)",
    ),
)
def suppress_by_rule(spark, sf_dir):
    rules, _, _ = fs.suppression_tables(derive.configs(spark, sf_dir))
    return shown(fs.suppress_by_rule(base_findings(spark, sf_dir), rules))


@query(
    "suppress_by_path",
    o.with_(*BASE, CONFIG, PATHS_SQL, f"{ALL} f ANTI JOIN hidden USING (repo, file_path)"),
)
def suppress_by_path(spark, sf_dir):
    _, globs, _ = fs.suppression_tables(derive.configs(spark, sf_dir))
    return shown(fs.suppress_by_path(stored(base_findings(spark, sf_dir)), globs))


# ---- dependency joins ----------------------------------------------------------------------------------


@query(
    "join_advisory",
    o.with_(
        derive.dependency_rows_sql(), ADVISORIES,
        f"""SELECT k, name, version, id, severity, fixed FROM dependency_rows d
            JOIN advisories a ON a.ecosystem = 'pypi' AND a.package = lower(d.name) WHERE {o.compare('version', 'fixed')} < 0""",
    ),
)
def join_advisory(spark, sf_dir):
    rows = derive.dependency_rows(spark, sf_dir).select(
        "k", "name", "version", F.lit("pypi").alias("ecosystem"), F.lit("").alias("repo"), F.lit("").alias("path"),
        F.col("k").alias("position"), F.lit(0).alias("line"),
    )
    # The advisories are handed in as a table of unknown size, so the interval index runs.
    return deps.join_advisory(rows, deps.advisory_table(spark)).select("k", "name", "version", "id", "severity", "fixed")


OSV_COLUMNS = ["repo", "rule_id", "severity", "file_path", "line", "snippet", "fixable", "remediation"]
OSV_SELECT = "SELECT " + ", ".join(OSV_COLUMNS)


@query("osv_findings", o.with_(*OSV, f"{OSV_SELECT} FROM osv_all"))
def osv_findings(spark, sf_dir):
    pins = deps.extract_dependencies(derive.manifest_corpus(spark, sf_dir))
    matched = osv.match_feed(pins, osv.osv_feed(derive.replies(spark, sf_dir)))
    return osv.osv_findings(matched).select(*OSV_COLUMNS)


@query(
    "osv_first_seen",
    o.with_(
        *OSV,
        f"""{OSV_SELECT} FROM osv_all
            QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY file_path, position, vuln_no) = 1""",
    ),
)
def osv_first_seen(spark, sf_dir):
    """The first finding of each id over the whole corpus taken as one scan."""
    pins = deps.extract_dependencies(derive.manifest_corpus(spark, sf_dir))
    matched = osv.match_feed(osv.first_dependencies(pins, []), osv.osv_feed(derive.replies(spark, sf_dir)))
    return osv.first_per_id(osv.osv_findings(matched), []).select(*OSV_COLUMNS)


@query(
    "join_osv_new_ids",
    o.with_(
        *OSV,
        f"""{OSV_SELECT} FROM osv_all WHERE (repo, rule_id) NOT IN (SELECT (repo, rule_id) FROM dep_f)
            QUALIFY row_number() OVER (PARTITION BY repo, rule_id ORDER BY file_path, position, vuln_no) = 1""",
    ),
)
def join_osv_new_ids(spark, sf_dir):
    """New ids of each repository, every repository being a scan of its own."""
    corpus = derive.manifest_corpus(spark, sf_dir)
    found = osv.scan_osv(deps.extract_dependencies(corpus), derive.replies(spark, sf_dir), deps.scan_dependencies(corpus))
    return found.select(*OSV_COLUMNS)


# ---- project joins ---------------------------------------------------------------------------------------

TREE = [derive.tree_sql(), o.env_tree_ctes()]


@query("prj_tracked", o.with_(*TREE, "SELECT repo, path FROM env_files WHERE (repo, path) IN (SELECT (repo, path) FROM tracked)"))
def prj_tracked(spark, sf_dir):
    committed, _ = project.split_tracked(project.env_files(derive.tree_files(spark, sf_dir)), derive.tracked(spark, sf_dir))
    return committed


@query("prj_gitignored", o.with_(*TREE, "SELECT repo, path FROM env_files WHERE (repo, path) NOT IN (SELECT (repo, path) FROM ignored)"))
def prj_gitignored(spark, sf_dir):
    corpus = derive.tree_files(spark, sf_dir)
    return project.not_ignored(project.env_files(corpus), project.gitignore_patterns(corpus))


# ---- deduplication and roots -----------------------------------------------------------------------------


def repeated_findings(spark, sf_dir):
    """Findings on all order lines, where a line may occur several times under different roots.

    The root is the part number's remainder. Lines with one root may be equal but for their text; then
    the finding with the smaller snippet is first.
    """
    rows = derive.line_rows(spark, sf_dir).withColumn("repo", F.concat_ws("#", "repo", (F.col("p") % 5).cast("string")))
    found = lines.scan_lines(rows.select("repo", "path", "line", "text"))
    root = F.substring_index("repo", "#", -1).cast("int")
    return found.withColumn("root_ordinal", root).withColumn("repo", F.substring_index("repo", "#", 1))


@query(
    "dedupe_findings",
    o.with_(
        derive.line_rows_sql(), "rooted AS (SELECT * REPLACE (repo || '#' || (p % 5) AS repo) FROM line_rows)",
        o.code_findings("f", "rooted"),
        f"""SELECT * REPLACE (string_split(repo, '#')[1] AS repo) FROM (
            {ALL} f QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line, "column"
            ORDER BY CAST(string_split(repo, '#')[2] AS INTEGER), ordinal, snippet) = 1)""",
    ),
)
def dedupe_findings(spark, sf_dir):
    return shown(fs.dedupe_findings(repeated_findings(spark, sf_dir)))


def _roots(spark, sf_dir):
    """Overlapping roots: the whole tree, a folder of it, and every file by itself."""
    files = derive.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    ext = derive.pick(derive.LINE_EXTS, "k")
    single = files.select(F.concat(F.lit("src/f"), F.col("k").cast("string"), ext).alias("root"), (F.col("k") + 3).alias("root_ordinal"))
    return single.unionByName(spark.createDataFrame([(".", 0), ("src/", 1), ("gone", 2)], "root string, root_ordinal bigint"))


@query("merge_roots", o.with_(*BASE, ALL + "f"))
def merge_roots(spark, sf_dir):
    return shown(fs.merge_roots(base_findings(spark, sf_dir), _roots(spark, sf_dir)))


@query(
    "scan_totals",
    o.with_(LINES, "SELECT 3 * count(DISTINCT path) AS scanned_files FROM unique_lines"),
)
def scan_totals(spark, sf_dir):
    files = derive.unique_lines(spark, sf_dir).select("path").distinct().withColumn("length", F.lit(100).cast("bigint"))
    return fs.scan_totals(files, _roots(spark, sf_dir))


# ---- counts, gate, order -----------------------------------------------------------------------------------

LEVELS = "levels AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {n})" for s, n in SEVERITY_RANKS.items()) + ") AS t(severity, severity_rank))"
COUNTS = "SELECT severity, severity_rank, coalesce(n, 0) AS n FROM levels LEFT JOIN (SELECT severity, count(*) AS n FROM {} GROUP BY 1) USING (severity)"


@query(
    "severity_counts",
    o.with_(derive.document_lines_sql(), o.secret_findings("f", "document_lines"), LEVELS, COUNTS.format("f")),
)
def severity_counts(spark, sf_dir):
    return fs.severity_counts(secret_documents(spark, sf_dir))


def secret_documents(spark, sf_dir):
    from ...operators.secrets import scan_secrets

    return scan_secrets(derive.with_content(derive.document_texts(spark, sf_dir)))


@query("severity_levels_join", o.with_(derive.responses_sql(), o.response_findings("f"), LEVELS, COUNTS.format("f")))
def severity_levels_join(spark, sf_dir):
    """Responses give no critical finding; the level is listed all the same."""
    return fs.severity_counts(scan_responses(derive.responses(spark, sf_dir)))


@query("severity_desc", o.with_(*BASE, LEVELS, COUNTS.format("f") + " ORDER BY severity_rank DESC"))
def severity_desc(spark, sf_dir):
    return fs.severity_desc(base_findings(spark, sf_dir))


@query("gate", o.with_(*BASE, "SELECT max(severity_rank) AS worst, CASE WHEN max(severity_rank) >= 3 THEN 2 ELSE 0 END AS exit_code FROM f"))
def gate(spark, sf_dir):
    return fs.gate(base_findings(spark, sf_dir), None, "HIGH")


@query(
    "gate_by_repo",
    o.with_(
        *BASE, CONFIG,
        """SELECT repo, worst, nullif(upper(fail_on), '') AS fail_on,
             CASE WHEN worst >= CASE upper(fail_on) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END
               THEN 2 ELSE 0 END AS exit_code
           FROM (SELECT repo, max(severity_rank) AS worst FROM f GROUP BY repo) LEFT JOIN configs USING (repo)""",
    ),
)
def gate_by_repo(spark, sf_dir):
    _, _, gates = fs.suppression_tables(derive.configs(spark, sf_dir))
    return fs.gate_by_repo(base_findings(spark, sf_dir), gates)


@query("fixable_count", o.with_(*BASE, "SELECT count(*) FILTER (fixable) AS fixable FROM f"))
def fixable_count(spark, sf_dir):
    return fs.fixable_count(base_findings(spark, sf_dir))


@query(
    "findings_by_file",
    o.with_(
        *BASE,
        """SELECT repo, file_path, line, count(*) AS n, count(*) FILTER (fixable) AS fixable, max(severity_rank) AS worst,
             string_agg(rule_id, ',' ORDER BY ordinal, "column") AS rules FROM f GROUP BY ALL""",
    ),
)
def findings_by_file(spark, sf_dir):
    return fs.findings_by_file(base_findings(spark, sf_dir))


@query(
    "sorted_findings",
    o.with_(*SCAN, f'{ALL} scan_f ORDER BY severity_rank DESC, file_path, line, rule_id, "column"'),
)
def sorted_findings(spark, sf_dir):
    found = all_findings(spark, sf_dir).withColumn("ordinal", F.lit(0))
    return shown(fs.sorted_findings(stored(found)))


@query(
    "ranked_findings",
    o.with_(
        *BASE,
        f"""SELECT {o.FINDING}, row_number() OVER (ORDER BY severity_rank DESC, file_path, line, rule_id, "column", ordinal, repo) AS rank FROM f""",
    ),
)
def ranked_findings(spark, sf_dir):
    return shown(fs.ranked_findings(base_findings(spark, sf_dir)), "rank")


RANGES = """ranges AS (
      SELECT ['PyYAML', 'requests', 'flask'][(r % 3) + 1] AS name, ['<', '<=', '>', '>=', '==', '~'][(r % 6) + 1] AS op,
        (r % 7) || '.' || (r % 50) || CASE WHEN r % 4 = 0 THEN '.0' ELSE '' END AS bound, 'A-' || r AS id
      FROM (SELECT p_partkey AS r FROM part WHERE p_partkey % 5 = 0))"""


@query(
    "advisory_ranges",
    o.with_(
        derive.dependency_rows_sql(), RANGES,
        f"""judged AS (SELECT k, d.name, version, id, op, {o.compare('version', 'bound')} AS c FROM dependency_rows d JOIN ranges r ON lower(d.name) = lower(r.name))""",
        """SELECT name, version, id, count(*) AS n FROM judged
        WHERE CASE op WHEN '<' THEN c < 0 WHEN '<=' THEN c <= 0 WHEN '>' THEN c > 0 WHEN '>=' THEN c >= 0 WHEN '==' THEN c = 0 ELSE false END
        GROUP BY name, version, id""",
    ),
)
def advisory_ranges(spark, sf_dir):
    """Many ranges per package, of every comparator and one that is unknown.

    Dependencies are counted by version before they meet the ranges: a version's ranges are the same for all of its copies.
    """
    rows = derive.dependency_rows(spark, sf_dir).groupBy("name", "version").agg(F.count("*").alias("copies")).select(
        "name", "version", F.lit("pypi").alias("ecosystem"), F.lit("").alias("repo"), F.lit("").alias("path"),
        F.xxhash64("name", "version").alias("position"), "copies",
    )
    r = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    bound = F.concat((r % 7).cast("string"), F.lit("."), (r % 50).cast("string"), F.when(r % 4 == 0, ".0").otherwise(""))
    ranges = derive.table(spark, sf_dir, "part").where(r % 5 == 0).select(
        F.lit("pypi").alias("ecosystem"), pick(["pyyaml", "requests", "flask"], r).alias("package"), pick(["<", "<=", ">", ">=", "==", "~"], r).alias("op"),
        parse_version(bound).alias("bound_key"), F.concat(F.lit("A-"), r.cast("string")).alias("id"),
    )
    return deps.join_advisory(rows, ranges).groupBy("name", "version", "id").agg(F.sum("copies").alias("n"))
