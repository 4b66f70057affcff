"""Queries over remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import dependencies as deps, lines, pyfacts, remediate as fix
from ...operators.findings import union_scanners
from ...operators.secrets import scan_secret_lines, scan_text
from ...sources.corpus import scannable, with_kind
from ...sources.tables import stored
from .. import derive, oracle as o
from .algebra import BASE, base_findings
from .registry import query, shown
from .rules import ALL, DEP_FINDINGS
from .scalars import REQ, env_sql, secret_fix_sql, ANCHORED

FIXABLE = "fixable AND rule_id IN ('PY006', 'PY009', 'PY010', 'PY013', 'GO004', 'SEC006') AND line > 0"
GO_FIX = r"regexp_replace(text, 'InsecureSkipVerify\s*:\s*true', 'InsecureSkipVerify: false', 'g')"


def _new_text(rule: str) -> str:
    go = rf"CASE WHEN regexp_matches(text, 'InsecureSkipVerify\s*:\s*true') THEN {GO_FIX} END"
    return f"CASE {rule} WHEN 'GO004' THEN {go} WHEN 'SEC006' THEN {secret_fix_sql('text')} END"


@query("fixable_filter", o.with_(*BASE, f"{ALL} f WHERE {FIXABLE}"))
def fixable_filter(spark, sf_dir):
    return shown(fix.fixable_filter(base_findings(spark, sf_dir)))


@query(
    "join_fixers",
    o.with_(
        *BASE,
        f"""SELECT f.repo, file_path AS path, f.line, rule_id, text, {_new_text('rule_id')} AS new_text
            FROM f JOIN unique_lines u ON u.repo = f.repo AND u.path = file_path AND u.line = f.line WHERE {FIXABLE.replace('line', 'f.line')}""",
    ),
)
def join_fixers(spark, sf_dir):
    joined = fix.join_fixers(base_findings(spark, sf_dir), derive.unique_lines(spark, sf_dir))
    return joined.select("repo", "path", "line", "rule_id", "text", "new_text")


FOLD = f"""picked AS (
      SELECT f.repo, file_path AS path, f.line, rule_id, text, {_new_text('rule_id')} AS fixed
      FROM f JOIN unique_lines u ON u.repo = f.repo AND u.path = file_path AND u.line = f.line WHERE {FIXABLE.replace('line', 'f.line')}),
    folded AS (
      SELECT repo, path, line, text, coalesce(fixed, text) AS new_text, CASE WHEN fixed IS NULL THEN 0 ELSE 1 END AS changes,
        CASE WHEN rule_id = 'SEC006' AND fixed IS NOT NULL THEN {env_sql(f"regexp_extract(text, {o.q(ANCHORED)}, 2)")} END AS name,
        CASE WHEN rule_id = 'SEC006' AND fixed IS NOT NULL THEN coalesce(nullif(regexp_extract(text, {o.q(ANCHORED)}, 3), ''),
          regexp_extract(text, {o.q(ANCHORED)}, 4)) END AS value
      FROM picked)"""


@query("line_fold", o.with_(*BASE, FOLD, "SELECT repo, path, line, text, new_text, changes, name, value FROM folded"))
def line_fold(spark, sf_dir):
    folded = fix.line_fold(base_findings(spark, sf_dir), derive.unique_lines(spark, sf_dir))
    first = F.get("env", F.lit(0))
    return folded.select(
        "repo", "path", "line", "text", "new_text", "changes", first["name"].alias("name"), first["value"].alias("value")
    )


@query(
    "reassemble_file",
    o.with_(
        derive.unique_lines_sql(),
        "SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS text, count(*) AS n_lines FROM unique_lines GROUP BY ALL",
    ),
)
def reassemble_file(spark, sf_dir):
    return fix.reassemble_file(derive.unique_lines(spark, sf_dir))


# ---- requirements --------------------------------------------------------------------------------------

REMEDY = r"regexp_extract(remediation, '>=\s*(\d+(?:\.\d+)*(?:[A-Za-z]\w*)?)', 1)"
TARGETS = f"""targets AS (
      SELECT repo, file_path AS path, lower(regexp_extract(snippet, '^([A-Za-z0-9._-]+)==', 1)) AS package,
        arg_max({REMEDY}, ordinal) AS target
      FROM dep_f WHERE category = 'dependency' AND fixable GROUP BY 1, 2, 3)"""


def dependency_findings(spark, sf_dir):
    return deps.scan_dependencies(derive.manifest_corpus(spark, sf_dir))


@query("dep_targets", o.with_(*DEP_FINDINGS, TARGETS, "SELECT repo, path, package, target FROM targets"))
def dep_targets(spark, sf_dir):
    return fix.dep_targets(dependency_findings(spark, sf_dir))


BUMP = f"""bumped AS (
      SELECT m.repo, m.path, line, raw AS text, regexp_extract(raw, {o.q(REQ)}, 1) || regexp_extract(raw, {o.q(REQ)}, 2) || '==' || target
        || regexp_extract(raw, {o.q(REQ)}, 5) AS new_text
      FROM manifest_all m JOIN targets t ON t.repo = m.repo AND t.path = m.path AND t.package = lower(regexp_extract(raw, {o.q(REQ)}, 2))
      WHERE regexp_extract(raw, {o.q(REQ)}, 4) <> target)"""


@query("join_dep_targets", o.with_(*DEP_FINDINGS, TARGETS, BUMP, "SELECT repo, path, line, text, new_text FROM bumped"))
def join_dep_targets(spark, sf_dir):
    files = derive.manifest_texts(spark, sf_dir).where(F.endswith("path", F.lit("requirements.txt")))
    return fix.join_dep_targets(lines.code_lines(files), fix.dep_targets(dependency_findings(spark, sf_dir)))


@query(
    "fix_requirements",
    o.with_(
        *DEP_FINDINGS, TARGETS, BUMP,
        """SELECT repo, path, string_agg(coalesce(b.new_text, raw), chr(10) ORDER BY line) AS fixed, CAST(count(b.line) AS INTEGER) AS change_count
           FROM manifest_all m LEFT JOIN bumped b USING (repo, path, line)
           WHERE (repo, path) IN (SELECT (repo, path) FROM bumped) GROUP BY ALL""",
    ),
)
def fix_requirements(spark, sf_dir):
    """Bumped requirements files; the final newline shows as an empty last line on both sides."""
    patched = fix.patched_files(derive.manifest_corpus(spark, sf_dir), stored(dependency_findings(spark, sf_dir)))
    return patched.select("repo", "path", "fixed", "change_count")


# ---- patched source files ---------------------------------------------------------------------------------

PRUNED = "scanned AS (SELECT repo, path, k, text, ext, step FROM code_texts WHERE NOT " + o.pruned("path") + ")"
FIXED_ROWS = ", ".join(
    f"({i}, {derive.text_sql(fixed)}, {n}, {'NULL' if at is None else at})"
    for i, (_t, _f, fixed, n, at) in enumerate(derive.PY)
    if fixed is not None
)
PATCHED = f"""go_lines AS (
      SELECT repo, path, line, text, line_no, regexp_matches(
          CASE WHEN strpos(text, '//') > 0 THEN left(text, strpos(text, '//') - 1) ELSE text END, 'InsecureSkipVerify\\s*:\\s*true') AS hit
      FROM (SELECT repo, path, unnest(p) AS text, generate_subscripts(p, 1) AS line, generate_subscripts(p, 1) AS line_no
            FROM (SELECT repo, path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM scanned WHERE ext = '.go'))),
    go_fixed AS (
      SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS original,
        string_agg(CASE WHEN hit THEN {GO_FIX} ELSE text END, chr(10) ORDER BY line) AS fixed,
        CAST(count(*) FILTER (hit) AS INTEGER) AS change_count, CAST(NULL AS INTEGER) AS import_at
      FROM go_lines GROUP BY repo, path HAVING bool_or(hit)),
    py_fixed AS (
      SELECT repo, path, text AS original, fixed, n AS change_count, import_at
      FROM scanned JOIN (VALUES {FIXED_ROWS}) AS t(no, fixed, n, import_at) ON ext = '.py' AND step % {len(derive.PY)} = no),
    patched AS (
      SELECT * FROM py_fixed UNION ALL SELECT * FROM go_fixed WHERE fixed <> original)"""
CODE = [derive.code_texts_sql(), PRUNED, PATCHED]


def code_findings(spark, sf_dir):
    """The files of a scan, stored by kind as each kind is read by its own scanners, and their findings."""
    files = scannable(stored(with_kind(derive.code_corpus(spark, sf_dir)), "kind"))
    return files, stored(union_scanners(scan_text(files), pyfacts.scan_python(files)))


def patched(spark, sf_dir):
    return fix.patched_files(*code_findings(spark, sf_dir))


@query("patched_files", o.with_(*CODE, "SELECT repo, path, original, fixed, change_count, import_at FROM patched"))
def patched_files(spark, sf_dir):
    return patched(spark, sf_dir).select("repo", "path", "original", "fixed", "change_count", "import_at")


@query("changed_files", o.with_(*CODE, "SELECT repo, path, change_count FROM patched"))
def changed_files(spark, sf_dir):
    return fix.changed_files(patched(spark, sf_dir))


@query("sorted_fixes", o.with_(*CODE, "SELECT repo, path, change_count FROM patched ORDER BY path, repo"))
def sorted_fixes(spark, sf_dir):
    return fix.sorted_fixes(patched(spark, sf_dir))


@query("change_totals", o.with_(*CODE, "SELECT count(*) AS files, CAST(sum(change_count) AS BIGINT) AS changes FROM patched"))
def change_totals(spark, sf_dir):
    return fix.change_totals(patched(spark, sf_dir))


@query(
    "fix_candidate_files",
    o.with_(
        derive.code_texts_sql(), PRUNED,
        o.lines_cte("file_lines", "scanned"), o.code_findings("code_f", "file_lines"),
        o.secret_findings("sec_f", "file_lines", True), o.python_findings("py_f", "scanned"),
        """SELECT DISTINCT repo, file_path AS path FROM (SELECT * FROM (SELECT repo, file_path, fixable FROM code_f UNION ALL
             SELECT repo, file_path, fixable FROM sec_f UNION ALL SELECT repo, file_path, fixable FROM py_f)) WHERE fixable""",
    ),
)
def fix_candidate_files(spark, sf_dir):
    return fix.fix_candidate_files(*code_findings(spark, sf_dir)).select("repo", "path")


# Changes with more than two contexts between them begin a new hunk.
@query(
    "diff_hunks",
    o.with_(
        *CODE,
        """counted AS (
             SELECT *, len(string_split(rtrim(original, chr(10)), chr(10))) AS n,
               change_count - CASE WHEN import_at IS NULL THEN 0 ELSE 1 END AS replaced,
               list_transform(string_split(rtrim(original, chr(10)), chr(10)), lambda x, i: i) AS all_no,
               string_split(rtrim(original, chr(10)), chr(10)) AS o, string_split(rtrim(fixed, chr(10)), chr(10)) AS f
             FROM patched),
           changed AS (
             SELECT *, list_filter(all_no, lambda i: o[i] <> f[i + CASE WHEN import_at IS NOT NULL AND i > import_at THEN 1 ELSE 0 END]) AS hits
             FROM counted),
           points AS (
             SELECT repo, path, n, import_at, unnest(hits) - 1 AS lo, unnest(hits) AS hi, 0 AS ins FROM changed
             UNION ALL SELECT repo, path, n, import_at, import_at, import_at, 1 FROM changed WHERE import_at IS NOT NULL),
           marked AS (
             SELECT *, CASE WHEN coalesce(lo - max(hi) OVER (PARTITION BY repo, path ORDER BY lo, hi, ins
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) > 6 THEN 1 ELSE 0 END AS new FROM points),
           hunks AS (
             SELECT *, sum(new) OVER (PARTITION BY repo, path ORDER BY lo, hi, ins ROWS UNBOUNDED PRECEDING) AS hunk FROM marked),
           ranged AS (
             SELECT repo, path, n, import_at, hunk, min(lo) AS first, max(hi) AS last, sum(ins) AS inserted, count(*) AS changes
             FROM hunks GROUP BY ALL)""",
        """SELECT repo, path, CAST(hunk AS INTEGER) AS hunk, CAST(greatest(first - 3, 0) + 1 AS INTEGER) AS old_start,
             CAST(least(last + 3, n) - greatest(first - 3, 0) AS INTEGER) AS old_lines,
             CAST(greatest(first - 3, 0) + 1 + CASE WHEN inserted = 0 AND import_at < first THEN 1 ELSE 0 END AS INTEGER) AS new_start,
             CAST(least(last + 3, n) - greatest(first - 3, 0) + inserted AS INTEGER) AS new_lines,
             CAST(changes AS INTEGER) AS changes FROM ranged""",
    ),
)
def diff_hunks(spark, sf_dir):
    return fix.diff_hunks(patched(spark, sf_dir))


ENV = """env_rows AS (
      SELECT repo, path, CASE change_count WHEN 4 THEN 'AUTH_TOKEN' ELSE CASE WHEN import_at = 0 THEN 'SECRET_KEY' ELSE 'MAIL_PASSWORD' END END AS name,
        CASE change_count WHEN 4 THEN 'hT6wq0Vz9LxB' ELSE CASE WHEN import_at = 0 THEN 'k3y-of-tests-0f9e8d7c' ELSE 'Tq8_vR!2mZx7Lw0' END END AS value
      FROM patched WHERE contains(fixed, 'os.environ'))"""


@query(
    "env_vars",
    o.with_(
        *CODE, ENV, "SELECT repo, name, arg_max(value, path) AS value, min(path) AS first_path FROM env_rows GROUP BY repo, name",
    ),
)
def env_vars(spark, sf_dir):
    found = fix.env_vars(patched(spark, sf_dir))
    return found.select("repo", "name", "value", F.col("first_seen.path").alias("first_path"))


@query(
    "env_example",
    o.with_(
        *CODE, ENV,
        """SELECT DISTINCT repo, name, name || '=CHANGE_ME' AS entry FROM env_rows
           WHERE NOT (CAST(substr(repo, 5) AS INTEGER) % 3 = 0 AND name IN ('AUTH_TOKEN', 'SECRET_KEY'))
             AND NOT (CAST(substr(repo, 5) AS INTEGER) % 3 = 1 AND name = 'MAIL_PASSWORD')""",
    ),
)
def env_example(spark, sf_dir):
    """Repositories with different .env.example files, one of which names a longer variable."""
    code = derive.code_corpus(spark, sf_dir)
    number = F.substr(F.col("repo"), F.lit(5)).cast("int")
    text = (
        F.when(number % 3 == 0, "# keys\nMY_AUTH_TOKEN=1\nSECRET_KEY=\n").when(number % 3 == 1, "MAIL_PASSWORD=x\nKEY = 1").otherwise("")
    )
    examples = code.select("repo").distinct().select("repo", F.lit(".env.example").alias("path"), text.alias("text"))
    found = fix.env_vars(patched(spark, sf_dir))
    return fix.env_example(found, code.unionByName(derive.with_content(examples)))


@query(
    "ensure_os_import",
    o.with_(
        derive.code_texts_sql(),
        rf"""files AS (
          SELECT repo, path, ext, CASE WHEN ext = '.py' THEN text || 'os.environ["A"]' || chr(10) ELSE text END AS text FROM code_texts),
        cut AS (
          SELECT *, regexp_split_to_array(text, '\r\n|\n') AS p FROM files),
        lined AS (
          SELECT *, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM cut),
        placed AS (
          SELECT *, list_position(list_transform(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')), true) AS pos FROM lined),
        wanted AS (
          SELECT *, contains(text, 'os.environ') AND NOT regexp_matches(text, '(?m)^\s*import os\b') AS need FROM placed)""",
        """SELECT repo, path, CASE WHEN need THEN CAST(pos - 1 AS INTEGER) END AS import_at,
             CASE WHEN need THEN array_to_string(list_concat(list_concat(l[1:pos - 1], ['import os']), l[pos:]), chr(10)) || chr(10) ELSE text END AS text
           FROM wanted""",
    ),
)
def ensure_os_import(spark, sf_dir):
    files = derive.code_texts(spark, sf_dir)
    uses = F.when(F.endswith("path", F.lit(".py")), F.concat("text", F.lit('os.environ["A"]\n'))).otherwise(F.col("text"))
    return fix.ensure_os_import(files.withColumn("text", uses)).select("repo", "path", "import_at", "text")
