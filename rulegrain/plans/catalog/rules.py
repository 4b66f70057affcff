"""Queries over the detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ...functions import paths, text as t
from ...operators import dependencies as deps, lines, project, pyfacts, responses, secrets
from ...operators.findings import sorted_findings
from ...operators.responses import RESPONSE_RULES
from ...operators.rules import GENERIC_SECRET, LINE_RULES, PYTHON_RULES, SECRET_RULES
from ...sources.corpus import with_kind
from ...sources.tables import stored
from .. import derive, expected, oracle as o
from ..facts import facts_of
from ..scan import scan
from .registry import FINDING_COLUMNS, ORACLES, query, shown
from .sources import feed_cte

CODE = derive.code_texts_sql()
CODE_LINES = o.lines_cte("file_lines", "code_texts")
LINES = derive.unique_lines_sql()
ALL = f"SELECT {o.FINDING} FROM "


@query("rule_match_line", o.with_(LINES, o.code_findings("f", "unique_lines"), ALL + "f"))
def rule_match_line(spark, sf_dir):
    return shown(lines.scan_lines(derive.unique_lines(spark, sf_dir)))


@query(
    "first_match_column",
    o.with_(
        LINES,
        r"""SELECT path, line, CASE WHEN regexp_matches(text, '[A-Z]\w*\s*\(')
              THEN CAST(length(regexp_extract(text, '^(.*?)(?:[A-Z]\w*\s*\()', 1)) + 1 AS INTEGER) END AS "column" FROM unique_lines""",
    ),
)
def first_match_column(spark, sf_dir):
    return derive.unique_lines(spark, sf_dir).select(
        "path", "line", t.first_match_column(F.col("text"), r"[A-Z]\w*\s*\(").alias("column")
    )


def _lang_query(name: str, prefix: str):
    sql = o.with_(CODE, CODE_LINES, o.code_findings("f", "file_lines"), f"{ALL} f WHERE starts_with(rule_id, '{prefix}')")

    @query(name, sql)
    def run(spark, sf_dir):
        rules = [r for r in LINE_RULES if r.rule_id.startswith(prefix)]
        return shown(lines.scan_code(derive.code_corpus(spark, sf_dir), rules))


_lang_query("js_findings", "JS")
_lang_query("go_findings", "GO")
_lang_query("java_findings", "JAVA")


@query("sec_findings", o.with_(derive.document_lines_sql(), o.secret_findings("f", "document_lines"), ALL + "f"))
def sec_findings(spark, sf_dir):
    files = derive.with_content(derive.document_texts(spark, sf_dir))
    return shown(secrets.scan_secrets(files))


@query(
    "sec_code_findings",
    o.with_(CODE, CODE_LINES, o.secret_findings("f", "file_lines", True), ALL + "f"),
)
def sec_code_findings(spark, sf_dir):
    return shown(secrets.scan_secrets(derive.code_corpus(spark, sf_dir)))


@query("py_findings", o.with_(CODE, o.python_findings("f"), ALL + "f"))
def py_findings(spark, sf_dir):
    return shown(pyfacts.scan_python(derive.code_corpus(spark, sf_dir)))


_COUNTED = {"calls": expected.CALLS, "assigns": expected.ASSIGNS, "consts": expected.CONSTS}


@query(
    "py_facts",
    o.with_(
        CODE,
        *[f"{n} AS (SELECT no, count(*) AS n FROM (VALUES {expected.values([r[:1] for r in rows])}) AS t(no) GROUP BY no)" for n, rows in _COUNTED.items()],
        "SELECT repo, path, "
        + ", ".join(f"coalesce({n}.n, 0) AS {n}" for n in _COUNTED)
        + ", CAST(text = 'while queue' || chr(10) AS BIGINT) AS errors FROM code_texts "
        + " ".join(f"LEFT JOIN {n} ON {n}.no = step % {len(derive.PY)}" for n in _COUNTED)
        + " WHERE ext = '.py' AND (" + " OR ".join(f"{n}.n IS NOT NULL" for n in _COUNTED) + " OR text = 'while queue' || chr(10))",
    ),
)
def py_facts(spark, sf_dir):
    """Facts of each kind in every file that has any, whether a rule asks for them or not."""
    facts = pyfacts.py_facts(pyfacts.python_sources(derive.code_corpus(spark, sf_dir)), watched=False)
    kinds = {"calls": "call", "assigns": "assign", "consts": "const", "errors": "syntax"}
    return facts.groupBy("repo", "path").agg(*[F.count_if(F.col("kind") == kind).alias(n) for n, kind in kinds.items()])


PY_LINES = "py_lines AS (SELECT repo, path, line, text FROM file_lines WHERE path LIKE '%.py')"
def _facts(spark, sf_dir, kind):
    return facts_of(derive.code_corpus(spark, sf_dir), kind)


def _expected(rows: list[tuple], columns: str, selected: str) -> str:
    """Every file with the facts that its template has."""
    return o.with_(
        CODE, f"expected AS (SELECT * FROM (VALUES {expected.values(rows)}) AS t(no, line, \"column\", {columns}))",
        f"""SELECT repo, path, line, "column", {selected} FROM code_texts JOIN expected ON ext = '.py' AND step % {len(derive.PY)} = no""",
    )


_AT = ["repo", "path", "line", "column"]


@query(
    "py_calls",
    _expected(
        expected.CALLS, "name, attr, keywords, n_args, dynamic_sql, arg1_safe",
        "name, attr IS NOT NULL AS is_attribute, attr, keywords, n_args, dynamic_sql, arg1_safe",
    ),
)
def py_calls(spark, sf_dir):
    """All calls with all their columns; the keywords as text."""
    shown_as = lambda k: F.concat(k["arg"], F.lit("="), F.coalesce(k["value"], F.lit("-")), F.when(k["safe"], "/safe").otherwise(""))
    keywords = F.array_join(F.transform("keywords", shown_as), " ")
    calls = _facts(spark, sf_dir, "call")
    return calls.select(*_AT, "name", "is_attribute", "attr", keywords.alias("keywords"), "n_args", "dynamic_sql", "arg1_safe")


@query("py_facts_by_content", _expected(expected.CONSTS, "name", "name"))
def py_facts_by_content(spark, sf_dir):
    """All texts of all files, of which many are copies: each distinct file is parsed once."""
    sources = pyfacts.python_sources(derive.code_corpus(spark, sf_dir))
    return pyfacts.facts_by_content(sources, watched=False).where("kind = 'const'").select(*_AT, "name")


@query("py_assigns", _expected(expected.ASSIGNS, "name, nonempty_str, has_star, is_true", "name, nonempty_str, has_star, is_true"))
def py_assigns(spark, sf_dir):
    """All assignments to names."""
    return _facts(spark, sf_dir, "assign").select(*_AT, "name", "nonempty_str", "has_star", "is_true")


@query("py_consts", _expected(expected.CONSTS, "name", "name"))
def py_consts(spark, sf_dir):
    """All texts that a file holds."""
    return _facts(spark, sf_dir, "const").select(*_AT, "name")


@query("py_parse_errors", o.with_(CODE, CODE_LINES, PY_LINES, "SELECT path, line FROM py_lines WHERE text = 'while queue'"))
def py_parse_errors(spark, sf_dir):
    return _facts(spark, sf_dir, "syntax").select("path", "line")


@query(
    "py_snippet",
    o.with_(CODE, o.python_findings("f"), 'SELECT file_path, rule_id, line, "column", snippet FROM f WHERE snippet <> \'\''),
)
def py_snippet(spark, sf_dir):
    found = pyfacts.scan_python(derive.code_corpus(spark, sf_dir))
    return found.select("file_path", "rule_id", "line", "column", "snippet").where("snippet != ''")


PATHS_SQL = """globs AS (SELECT repo, unnest(ignore_paths) AS g FROM configs),
    hidden AS (
      SELECT DISTINCT repo, file_path FROM (SELECT DISTINCT repo, file_path FROM f) JOIN globs USING (repo)
      WHERE CASE WHEN ends_with(g, '/') THEN starts_with(file_path, g) OR contains('/' || file_path, '/' || g)
        ELSE file_path GLOB g OR string_split(file_path, '/')[-1] GLOB g OR file_path GLOB ('*/' || g) END)"""
ADVISORIES = o.advisories_cte(deps.ADVISORIES)
MANIFESTS = [derive.manifest_texts_sql(), o.requirement_lines(), o.requirement_deps("pypi", "pypi", False), o.package_deps()]
DEPS = "deps AS (SELECT * FROM pypi UNION ALL SELECT * FROM package_deps)"
DEP_FINDINGS = [*MANIFESTS, DEPS, ADVISORIES, o.dependency_findings("dep_f", "deps")]


@query("dep_findings", o.with_(*DEP_FINDINGS, f"SELECT {o.FINDING}, remediation FROM dep_f"))
def dep_findings(spark, sf_dir):
    return shown(deps.scan_dependencies(derive.manifest_corpus(spark, sf_dir)), "remediation")


PRJ = o.with_(
    derive.tree_sql(), o.env_tree_ctes(),
    """SELECT repo, path AS file_path, 'PRJ002' AS rule_id, 'CRITICAL' AS severity, 'CWE-538' AS cwe, 'project' AS category
         FROM env_files WHERE (repo, path) IN (SELECT (repo, path) FROM tracked)
       UNION ALL
       SELECT repo, path, 'PRJ001', 'HIGH', 'CWE-538', 'project' FROM env_files
         WHERE (repo, path) NOT IN (SELECT (repo, path) FROM tracked) AND (repo, path) NOT IN (SELECT (repo, path) FROM ignored)""",
)


@query("prj_findings", PRJ)
def prj_findings(spark, sf_dir):
    found = project.scan_project(derive.tree_files(spark, sf_dir), derive.tracked(spark, sf_dir))
    return found.select("repo", "file_path", "rule_id", "severity", "cwe", "category")


@query("dast_findings", o.with_(derive.responses_sql(), o.response_findings("f"), ALL + "f"))
def dast_findings(spark, sf_dir):
    return shown(responses.scan_responses(derive.responses(spark, sf_dir)))


OSV = [
    *DEP_FINDINGS,
    o.requirement_deps("osv_pins", "PyPI", True),
    "osv_deps AS (SELECT * FROM osv_pins UNION ALL SELECT * FROM package_deps)",
    derive.dependency_rows_sql(),
    derive.replies_sql(),
    feed_cte(),
    """osv_all AS (
      SELECT repo, id AS rule_id, severity, path AS file_path, line, name || '==' || version AS snippet, fixed IS NOT NULL AS fixable,
        position, vuln_no, CASE WHEN fixed IS NOT NULL THEN 'Upgrade ' || name || ' to >= ' || fixed || '.'
          ELSE 'Upgrade ' || name || '; see advisory ' || id END AS remediation
      FROM osv_deps JOIN feed USING (ecosystem, name, version))""",
    """osv_new AS (
      SELECT * FROM osv_all WHERE (repo, rule_id) NOT IN (SELECT (repo, rule_id) FROM dep_f)
      QUALIFY row_number() OVER (PARTITION BY repo, rule_id ORDER BY file_path, position, vuln_no) = 1)""",
]
NO_CWE = "CAST(NULL AS VARCHAR) AS cwe"
SCAN = [
    CODE,
    "scanned AS (SELECT repo, path, text, ext, step FROM code_texts WHERE NOT " + o.pruned("path") + ")",
    o.lines_cte("file_lines", "scanned"),
    o.code_findings("code_f", "file_lines"),
    o.secret_findings("sec_f", "file_lines", True),
    o.python_findings("py_f", "scanned"),
    *OSV,
    f"prj_f AS ({PRJ})",
    f"""scan_f AS (
      {ALL} code_f UNION ALL {ALL} sec_f UNION ALL {ALL} py_f UNION ALL {ALL} dep_f
      UNION ALL SELECT repo, rule_id, severity, {o.RANK} AS severity_rank, file_path, 0 AS line, 0 AS "column", cwe, '' AS snippet, category,
        false AS fixable FROM prj_f
      UNION ALL SELECT repo, rule_id, severity, {o.RANK}, file_path, line, 0, {NO_CWE}, snippet, 'dependency', fixable FROM osv_new)""",
]


def scan_corpus(spark, sf_dir):
    """Source files, manifests, environment and ignore files in one corpus, stored by kind.

    A scan reads it a dozen times, mostly one kind of it: the texts are made once, and other kinds are skipped.
    """
    parts = derive.code_corpus, derive.manifest_corpus, derive.tree_files
    return stored(with_kind(reduce(DataFrame.unionByName, [part(spark, sf_dir) for part in parts])), "kind")


@query("all_findings", o.with_(*SCAN, ALL + "scan_f"))
def all_findings(spark, sf_dir):
    """The whole scan: project, unreadable files, code, secrets, dependencies and feed."""
    return shown(scan(scan_corpus(spark, sf_dir), derive.tracked(spark, sf_dir), replies=derive.replies(spark, sf_dir)).findings)


IGNORED = ["PY007", "SEC006"], ["legacy/", "*.java"]


@query(
    "scan",
    o.with_(
        *SCAN, derive.configs_sql(), f"f AS (SELECT * FROM scan_f WHERE rule_id NOT IN {o.in_list(IGNORED[0])})", PATHS_SQL,
        f"""{ALL} f ANTI JOIN hidden USING (repo, file_path)
            WHERE (repo, rule_id) NOT IN (SELECT (repo, unnest(ignore_rules)) FROM configs)
              AND NOT (starts_with(file_path, 'legacy/') OR contains(file_path, '/legacy/') OR ends_with(file_path, '.java'))
            QUALIFY row_number() OVER (PARTITION BY repo, rule_id, file_path, line, "column") = 1
            ORDER BY severity_rank DESC, file_path, line, rule_id, "column" """,
    ),
)
def scan_query(spark, sf_dir):
    """Two overlapping roots, suppression of the whole scan and by repository, each finding once, in report order."""
    roots = spark.createDataFrame([(".", 0), ("src/", 1)], "root string, root_ordinal bigint")
    found = scan(
        scan_corpus(spark, sf_dir), derive.tracked(spark, sf_dir), replies=derive.replies(spark, sf_dir),
        ignore_rules=IGNORED[0], ignore_paths=IGNORED[1], config=derive.configs(spark, sf_dir), roots=roots,
    )
    return shown(sorted_findings(stored(found.findings)))


@query("union_scanners", o.with_(*SCAN, "SELECT category, rule_id, count(*) AS n FROM scan_f GROUP BY ALL"))
def union_scanners_query(spark, sf_dir):
    return all_findings(spark, sf_dir).groupBy("category", "rule_id").agg(F.count("*").alias("n"))


# ---- one query per rule ------------------------------------------------------------------------------

FILES_OF = {"js": paths.JS_EXT, "go": paths.GO_EXT, "java": paths.JAVA_EXT}


def _code_rule(rule):
    sql = o.with_(CODE, CODE_LINES, o.code_findings("f", "file_lines"), f"{ALL} f WHERE rule_id = '{rule.rule_id}'")

    @query(rule.rule_id, sql)
    def run(spark, sf_dir):
        return shown(lines.scan_code(derive.code_corpus(spark, sf_dir), [rule]))


def _secret_rule(rule):
    sql = o.with_(CODE, CODE_LINES, o.secret_findings("f", "file_lines", True), f"{ALL} f WHERE rule_id = '{rule.rule_id}'")

    @query(rule.rule_id, sql)
    def run(spark, sf_dir):
        return shown(secrets.scan_secrets(derive.code_corpus(spark, sf_dir))).where(F.col("rule_id") == rule.rule_id)


def _python_rule(rule):
    @query(rule.rule_id, o.with_(CODE, o.python_findings("f"), f"{ALL} f WHERE rule_id = '{rule.rule_id}'"))
    def run(spark, sf_dir):
        return shown(pyfacts.scan_python(derive.code_corpus(spark, sf_dir))).where(F.col("rule_id") == rule.rule_id)


def _response_rule(rule_id):
    @query(rule_id, o.with_(derive.responses_sql(), o.response_findings("f"), f"{ALL} f WHERE rule_id = '{rule_id}'"))
    def run(spark, sf_dir):
        return shown(responses.scan_responses(derive.responses(spark, sf_dir))).where(F.col("rule_id") == rule_id)


for _rule in LINE_RULES:
    _code_rule(_rule)
for _rule in [*SECRET_RULES, GENERIC_SECRET]:
    _secret_rule(_rule)
for _rule in PYTHON_RULES:
    _python_rule(_rule)
for _rule_id in RESPONSE_RULES:
    _response_rule(_rule_id)
for _rule_id in ("PRJ001", "PRJ002"):

    def _project_rule(rule_id=_rule_id):
        @query(rule_id, f"SELECT * FROM ({PRJ}) WHERE rule_id = '{rule_id}'")
        def run(spark, sf_dir):
            return prj_findings(spark, sf_dir).where(F.col("rule_id") == rule_id)

    _project_rule()
