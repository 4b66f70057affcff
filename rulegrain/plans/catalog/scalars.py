"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import advisories as adv, paths, text as t, versions as v, web
from ...operators import remediate as fix
from ...operators.rules import SECRET_NAMES
from ...operators.secrets import assigned_value
from ...schema import SEVERITY_RANKS, sarif_level, severity_rank
from ...sinks.reports import finding_location
from .. import derive, oracle as o
from .registry import query

DEPS = derive.dependency_rows_sql()
LINES = derive.unique_lines_sql()
CODE = derive.code_texts_sql()
CODE_LINES = o.lines_cte("file_lines", "code_texts")


def _versions(spark, sf_dir):
    return derive.dependency_rows(spark, sf_dir)


@query("parse_version", o.with_(DEPS, f"SELECT k, version, array_to_string(list_transform({o.parse_version('version')}, lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')), '.') AS key FROM dependency_rows"))
def parse_version(spark, sf_dir):
    key = F.array_join(F.transform(v.parse_version(F.col("version")), lambda n: n["digits"]), ".")
    return _versions(spark, sf_dir).select("k", "version", key.alias("key"))


BOUNDS = ["2.5", "3.10.0", "2", "4.20.20", "1.0.0.0"]


@query("compare_version", o.with_(DEPS, f"SELECT k, version, bound, {o.compare('version', 'bound')} AS cmp FROM (SELECT *, {derive.pick_sql(BOUNDS, 'k')} AS bound FROM dependency_rows)"))
def compare_version(spark, sf_dir):
    rows = _versions(spark, sf_dir).withColumn("bound", derive.pick(BOUNDS, "k"))
    return rows.select("k", "version", "bound", v.compare_version(F.col("version"), F.col("bound")).alias("cmp"))


SPECS = ["<5.4", " <= 2.31", ">3, <4", ">=1.0.0", "==2.5.0", "~=2.0", "any"]


@query(
    "is_vulnerable",
    o.with_(
        DEPS,
        f"""specs AS (SELECT k, version, {derive.pick_sql(SPECS, 'k')} AS spec FROM dependency_rows),
        split AS (SELECT *, regexp_extract(spec, '^\\s*(<=|>=|<|>|==)\\s*(.+)', 1) AS op,
          trim(regexp_extract(spec, '^\\s*(<=|>=|<|>|==)\\s*(.+)', 2)) AS bound FROM specs),
        compared AS (SELECT *, {o.compare('version', 'bound')} AS cmp FROM split)""",
        """SELECT k, version, spec, CASE op WHEN '<' THEN cmp < 0 WHEN '<=' THEN cmp <= 0 WHEN '>' THEN cmp > 0
             WHEN '>=' THEN cmp >= 0 WHEN '==' THEN cmp = 0 ELSE false END AS vulnerable FROM compared""",
    ),
)
def is_vulnerable(spark, sf_dir):
    rows = _versions(spark, sf_dir).withColumn("spec", derive.pick(SPECS, "k"))
    return rows.select("k", "version", "spec", v.is_vulnerable(F.col("version"), F.col("spec")).alias("vulnerable"))


PREFIXES = ["^", "~", "=", "", "^~=", " ", ">=", "v"]


@query(
    "clean_version",
    o.with_(
        DEPS,
        rf"""SELECT k, raw, nullif(regexp_extract(ltrim(ltrim(trim(raw), '^~'), '='), '^\d+(?:\.\d+)*'), '') AS version
             FROM (SELECT k, {derive.pick_sql(PREFIXES, 'k')} || version AS raw FROM dependency_rows)""",
    ),
)
def clean_version(spark, sf_dir):
    raw = F.concat(derive.pick(PREFIXES, "k"), F.col("version"))
    rows = _versions(spark, sf_dir).select("k", raw.alias("raw"))
    return rows.select("k", "raw", v.clean_version(F.col("raw")).alias("version"))


REMEDIES = ["Upgrade x to >= {}.", "Upgrade x; see advisory {}", "needs >={}", ">= v{}"]


def _remedy():
    out = None
    for i, text in enumerate(REMEDIES):
        before, after = text.split("{}")
        value = F.concat(F.lit(before), F.col("version"), F.lit(after))
        out = F.when(F.col("k") % len(REMEDIES) == i, value) if out is None else out.when(F.col("k") % len(REMEDIES) == i, value)
    return out


def _remedy_sql():
    cases = []
    for i, text in enumerate(REMEDIES):
        before, after = text.split("{}")
        cases.append(f"WHEN {i} THEN {o.q(before)} || version || {o.q(after)}")
    return f"CASE k % {len(REMEDIES)} {' '.join(cases)} END"


@query(
    "fixed_from_remediation",
    o.with_(
        DEPS,
        rf"""SELECT k, remediation, nullif(regexp_extract(remediation, '>=\s*(\d+(?:\.\d+)*(?:[A-Za-z]\w*)?)', 1), '') AS fixed
             FROM (SELECT k, {_remedy_sql()} AS remediation FROM dependency_rows)""",
    ),
)
def fixed_from_remediation(spark, sf_dir):
    rows = _versions(spark, sf_dir).select("k", _remedy().alias("remediation"))
    return rows.withColumn("fixed", v.fixed_from_remediation(F.col("remediation")))


@query(
    "package_from_snippet",
    o.with_(
        DEPS,
        """SELECT k, snippet, nullif(regexp_extract(snippet, '^([A-Za-z0-9._-]+)==', 1), '') AS package
           FROM (SELECT k, name || CASE WHEN k % 3 = 0 THEN ' ==' ELSE '==' END || version AS snippet FROM dependency_rows)""",
    ),
)
def package_from_snippet(spark, sf_dir):
    snippet = F.concat("name", F.when(F.col("k") % 3 == 0, " ==").otherwise("=="), "version")
    rows = _versions(spark, sf_dir).select("k", snippet.alias("snippet"))
    return rows.withColumn("package", v.package_from_snippet(F.col("snippet")))


REQ = r"^(\s*)([A-Za-z0-9._-]+)(\s*==\s*)([0-9][\w.]*)(.*)"


@query(
    "bump_requirement",
    o.with_(
        derive.manifest_texts_sql(), o.requirement_lines(),
        f"""SELECT path, line, raw AS text, CASE WHEN regexp_matches(raw, {o.q(REQ)}) AND regexp_extract(raw, {o.q(REQ)}, 4) <> '2.3.2'
              THEN regexp_extract(raw, {o.q(REQ)}, 1) || regexp_extract(raw, {o.q(REQ)}, 2) || '==2.3.2' || regexp_extract(raw, {o.q(REQ)}, 5) END AS new_text
            FROM manifest_all WHERE raw <> ''""",
    ),
)
def bump_requirement(spark, sf_dir):
    from ...functions.text import NEWLINES
    from ...operators.lines import code_lines

    files = derive.manifest_texts(spark, sf_dir).where(F.endswith("path", F.lit("requirements.txt")))
    lines = code_lines(files, ends=NEWLINES).where("text != ''")
    return lines.select("path", "line", "text", v.bump_requirement(F.col("text"), F.lit("2.3.2")).alias("new_text"))


GLOBS = ["*.js", "legacy/", "src/*", "lib/util", "f?2.go", "*/f[0-4]*.java", "build/", "f10.cfg", "[!sl]*", "web/static/*.md"]


def _glob_sql(path: str, glob: str) -> str:
    stem = f"rtrim({glob}, '/')"
    return f"""CASE WHEN ends_with({glob}, '/') THEN {path} = {stem} OR starts_with({path}, {stem} || '/')
        OR contains('/' || {path}, '/' || {stem} || '/')
      ELSE {path} GLOB {glob} OR {o.name_of(path)} GLOB {glob} OR {path} GLOB ('*/' || {glob}) END"""


@query(
    "path_glob",
    o.with_(CODE, f"SELECT path, pattern, {_glob_sql('path', 'pattern')} AS covered FROM (SELECT path, {derive.pick_sql(GLOBS, 'k + c')} AS pattern FROM code_texts)"),
)
def path_glob(spark, sf_dir):
    key = F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint")
    orders = derive.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    files = derive.code_texts(spark, sf_dir).select("path", key.alias("k")).join(orders, "k")
    rows = files.select("path", derive.pick(GLOBS, "k + c").alias("pattern"))
    return rows.withColumn("covered", paths.path_glob(F.col("path"), F.col("pattern")))


IGNORE = [".env", "*.env", "/svc*", "a", "build", ".e", "*", "svc1?/.env", "*.e[!x]v*", "", "b*/x"]


@query(
    "gitignore_match",
    o.with_(
        derive.tree_sql(),
        f"""rows AS (SELECT path, {derive.pick_sql(IGNORE, 'length(path)')} AS pattern FROM env_tree),
        cut AS (SELECT path, pattern, ltrim(pattern, '/') AS g FROM rows)""",
        f"""SELECT path, pattern, {o.name_of('path')} GLOB g OR path GLOB g OR path GLOB ('*/' || g)
              OR path GLOB (rtrim(g, '*') || '*') AS covered FROM cut""",
    ),
)
def gitignore_match(spark, sf_dir):
    files = derive.tree_files(spark, sf_dir).where(~F.endswith("path", F.lit(".gitignore"))).select("path")
    rows = files.withColumn("pattern", derive.pick(IGNORE, "length(path)"))
    return rows.withColumn("covered", paths.gitignore_match(F.col("path"), F.col("pattern")))


@query(
    "is_secret_env_name",
    o.with_(
        derive.tree_sql(),
        f"""SELECT repo, path, {o.name_of('path')} IN {o.in_list(paths.ENV_NAMES)} OR (starts_with({o.name_of('path')}, '.env')
              AND NOT regexp_matches(path, '\\.(example|sample|template|dist)$')) AS secret FROM env_tree""",
    ),
)
def is_secret_env_name(spark, sf_dir):
    files = derive.tree_files(spark, sf_dir).where(~F.endswith("path", F.lit(".gitignore")))
    return files.select("repo", "path", paths.is_secret_env_name(paths.basename(F.col("path"))).alias("secret"))


VARIABLES = ["apiKey", "api_key", "dbPassword2", "__token", "HTTPSecret", "my-api-key", "accessKeyID"]


@query(
    "env_name",
    o.with_(
        DEPS,
        r"""SELECT k, variable, trim(upper(regexp_replace(regexp_replace(variable, '([a-z0-9])([A-Z])', '\1_\2', 'g'),
              '[^A-Za-z0-9]+', '_', 'g')), '_') AS env
            FROM (SELECT k, """ + derive.pick_sql(VARIABLES, "k") + r""" || name AS variable FROM dependency_rows)""",
    ),
)
def env_name(spark, sf_dir):
    variable = F.concat(derive.pick(VARIABLES, "k"), F.col("name"))
    rows = _versions(spark, sf_dir).select("k", variable.alias("variable"))
    return rows.withColumn("env", t.env_name(F.col("variable")))


@query(
    "cookie_flags",
    o.with_(
        derive.responses_sql(),
        """SELECT url, cookie, array_to_string(list_sort(list_distinct(list_transform(string_split(cookie, ';'), lambda x: lower(trim(x))))), '|') AS flags
           FROM (SELECT url, unnest(cookies) AS cookie FROM responses)""",
    ),
)
def cookie_flags(spark, sf_dir):
    rows = derive.responses(spark, sf_dir).select("url", F.explode("cookies").alias("cookie"))
    return rows.withColumn("flags", F.array_join(F.array_sort(web.cookie_flags(F.col("cookie"))), "|"))


@query(
    "cookie_name",
    o.with_(derive.responses_sql(), "SELECT url, cookie, trim(string_split(cookie, '=')[1]) AS name FROM (SELECT url, unnest(cookies) AS cookie FROM responses)"),
)
def cookie_name(spark, sf_dir):
    rows = derive.responses(spark, sf_dir).select("url", F.explode("cookies").alias("cookie"))
    return rows.withColumn("name", web.cookie_name(F.col("cookie")))


@query("has_digit", "SELECT page_id, regexp_matches(url, '[0-9]') AS digit FROM pages")
def has_digit(spark, sf_dir):
    return derive.table(spark, sf_dir, "pages").select("page_id", t.has_digit(F.col("url")).alias("digit"))


@query("url_scheme", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM pages")
def url_scheme(spark, sf_dir):
    return derive.table(spark, sf_dir, "pages").select("page_id", web.url_scheme(F.col("url")).alias("scheme"))


@query(
    "severity_rank",
    o.with_(derive.timed_sql(), "SELECT ts, file_path, severity, CAST(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS INTEGER) AS severity_rank FROM timed"),
)
def severity_rank_query(spark, sf_dir):
    rows = derive.timed(derive.table(spark, sf_dir, "events"))
    return rows.select(derive.wall_clock("ts"), "file_path", "severity", severity_rank(F.col("severity")).alias("severity_rank"))


@query(
    "sarif_level",
    o.with_(derive.timed_sql(), "SELECT ts, file_path, severity, CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END AS level FROM timed"),
)
def sarif_level_query(spark, sf_dir):
    rows = derive.timed(derive.table(spark, sf_dir, "events"))
    return rows.select(derive.wall_clock("ts"), "file_path", "severity", sarif_level(F.col("severity")).alias("level"))


@query("py_strip", o.with_(LINES, f"SELECT path, line, {o.strip('text')} AS stripped FROM unique_lines"))
def py_strip(spark, sf_dir):
    return derive.unique_lines(spark, sf_dir).select("path", "line", t.py_strip(F.col("text")).alias("stripped"))


@query(
    "finding_location",
    o.with_(
        LINES, o.code_findings("f", "unique_lines"),
        "SELECT rule_id, file_path, line, file_path || ':' || line AS location FROM f",
    ),
)
def finding_location_query(spark, sf_dir):
    from ...operators.lines import scan_lines

    return scan_lines(derive.unique_lines(spark, sf_dir)).select("rule_id", "file_path", "line", finding_location().alias("location"))


@query("shannon_entropy", o.with_(LINES, f"SELECT path, line, CASE WHEN text = '' THEN 0.0::DOUBLE ELSE round({o.entropy('text')}, 6) END AS bits FROM unique_lines"))
def shannon_entropy(spark, sf_dir):
    bits = F.round(t.shannon_entropy(F.col("text")), 6)
    return derive.unique_lines(spark, sf_dir).select("path", "line", bits.alias("bits"))


# ---- advisory replies --------------------------------------------------------------------------------

FEED = [DEPS, derive.replies_sql()]


def _vulns(spark, sf_dir):
    parsed = derive.replies(spark, sf_dir).withColumn("r", F.from_json("body", adv.REPLY_SCHEMA))
    return parsed.select("name", "version", F.explode("r.vulns").alias("v"))


@query(
    "osv_severity",
    o.with_(
        *FEED,
        """SELECT name, version, 'GHSA-' || (last % 50) AS id,
             CASE (n + last) % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 5 THEN 'HIGH'
               ELSE CASE (m + last) % 6 WHEN 0 THEN 'CRITICAL' WHEN 4 THEN 'MEDIUM' ELSE 'HIGH' END END AS severity
           FROM replies WHERE last % 8 <> 7
           UNION ALL SELECT name, version, 'CVE-2020-14343', 'MEDIUM' FROM replies WHERE last % 8 <> 7""",
    ),
)
def osv_severity(spark, sf_dir):
    level = adv.advisory_severity(F.col("v.database_specific.severity"), F.col("v.severity"))
    return _vulns(spark, sf_dir).select("name", "version", "v.id", level.alias("severity"))


@query(
    "osv_first_score",
    o.with_(
        *FEED,
        """SELECT name, version, 'GHSA-' || (last % 50) AS id,
             CAST(CASE (m + last) % 6 WHEN 0 THEN 9.8 WHEN 1 THEN 7.5 WHEN 4 THEN 5.0 ELSE 8.1 END AS DOUBLE) AS score
           FROM replies WHERE last % 8 <> 7
           UNION ALL SELECT name, version, 'CVE-2020-14343', NULL FROM replies WHERE last % 8 <> 7""",
    ),
)
def osv_first_score(spark, sf_dir):
    return _vulns(spark, sf_dir).select("name", "version", "v.id", adv.first_score(F.col("v.severity")).alias("score"))


@query(
    "osv_summary",
    o.with_(
        *FEED,
        """SELECT name, version, 'GHSA-' || (last % 50) AS id,
             CASE last % 4 WHEN 0 THEN 'First line' WHEN 3 THEN 'Plain' ELSE 'Details here' END AS summary
           FROM replies WHERE last % 8 <> 7
           UNION ALL SELECT name, version, 'CVE-2020-14343', 'Known vulnerability.' FROM replies WHERE last % 8 <> 7""",
    ),
)
def osv_summary(spark, sf_dir):
    text = adv.advisory_summary(F.col("v.summary"), F.col("v.details"))
    return _vulns(spark, sf_dir).select("name", "version", "v.id", text.alias("summary"))


@query(
    "osv_first_fixed",
    o.with_(
        *FEED,
        """SELECT name, version, 'GHSA-' || (last % 50) AS id, CASE WHEN last % 3 <> 0 THEN (last + 1) || '.0' END AS fixed
           FROM replies WHERE last % 8 <> 7
           UNION ALL SELECT name, version, 'CVE-2020-14343', NULL FROM replies WHERE last % 8 <> 7""",
    ),
)
def osv_first_fixed(spark, sf_dir):
    return _vulns(spark, sf_dir).select("name", "version", "v.id", adv.first_fixed(F.col("v.affected"), F.col("name")).alias("fixed"))


# ---- line fixers -------------------------------------------------------------------------------------

_PLAIN_FIXES = {
    "fix_verify_false": (fix.fix_verify_false, r"verify\s*=\s*False", "verify=True"),
    "fix_debug_true": (fix.fix_debug_true, r"debug\s*=\s*True", "debug=False"),
    "fix_autoescape_false": (fix.fix_autoescape_false, r"autoescape\s*=\s*False", "autoescape=True"),
    "fix_insecure_skip_verify": (fix.fix_insecure_skip_verify, r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false"),
}


def _file_lines(spark, sf_dir):
    from ...operators.lines import code_lines

    return code_lines(derive.code_texts(spark, sf_dir)).select("path", "line", "text")


def _fix_query(name, fixer, new_sql):
    @query(name, o.with_(CODE, CODE_LINES, f"SELECT path, line, {new_sql} AS new_text FROM file_lines"))
    def run(spark, sf_dir):
        return _file_lines(spark, sf_dir).select("path", "line", fixer(F.col("text")).alias("new_text"))


for _name, (_fixer, _pattern, _text) in _PLAIN_FIXES.items():
    _fix_query(
        _name, _fixer,
        f"CASE WHEN regexp_matches(text, '{_pattern}') THEN regexp_replace(text, '{_pattern}', '{_text}', 'g') END",
    )
_fix_query(
    "fix_yaml_load", fix.fix_yaml_load,
    "CASE WHEN contains(text, 'yaml.load(') AND NOT contains(text, 'Loader') THEN replace(text, 'yaml.load(', 'yaml.safe_load(') END",
)

ANCHORED = rf"(?i)^(\s*(\w*(?:{SECRET_NAMES})\w*)\s*[:=]\s*){o._VALUE}(.*)$"


def secret_fix_sql(text: str) -> str:
    def group(n):
        return f"regexp_extract({text}, {o.q(ANCHORED)}, {n})"

    env = env_sql(group(2))
    return f"""CASE WHEN regexp_matches({text}, {o.q(ANCHORED)}) THEN {group(1)} || 'os.environ["' || {env} || '"]' || {group(5)} END"""


def env_sql(name: str) -> str:
    return rf"trim(upper(regexp_replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_')"


_fix_query("fix_hardcoded_secret", fix.fix_hardcoded_secret, secret_fix_sql("text"))


@query(
    "secret_assignment",
    o.with_(
        CODE, CODE_LINES,
        f"""SELECT path, line, coalesce(nullif(regexp_extract(text, {o.q('(?i)' + o.ASSIGNED)}, 1), ''),
              regexp_extract(text, {o.q('(?i)' + o.ASSIGNED)}, 2)) AS value FROM file_lines""",
    ),
)
def secret_assignment(spark, sf_dir):
    return _file_lines(spark, sf_dir).select("path", "line", assigned_value(F.col("text")).alias("value"))
