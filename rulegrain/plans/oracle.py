"""SQL pieces for checking queries on another engine."""

from __future__ import annotations

from ..functions import paths
from ..functions.text import SPACES
from ..operators.lines import LANG_EXT
from ..operators.responses import RESPONSE_RULES
from ..operators.rules import GENERIC_SECRET, LINE_RULES, PLACEHOLDER, PYTHON_RULES, SECRET_NAMES, SECRET_RULES
from ..schema import SEVERITY_RANKS
from . import derive

FINDING = (
    "repo, rule_id, severity, severity_rank, file_path, line, \"column\", cwe, snippet, category, fixable"
)

# RE2 knows no lookbehind: the one rule that uses it is spelled by what may stand before.
_BEFORE = {"JS003": r"(?:^|[^.\w])eval\s*\("}
_PREFIX = {"JS003": r"^((?:.*?[^.\w])??)eval\s*\("}

_VALUE = "(?:\"([^'\"\\n]{6,})\"|'([^'\"\\n]{6,})')"
ASSIGNED = rf"(?:{SECRET_NAMES})\w*\s*[:=]\s*{_VALUE}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    """CTEs and the final statement."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def strip(value: str) -> str:
    chars = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"trim({value}, {chars})"


def ext_of(path: str) -> str:
    return rf"regexp_extract(lower({path}), '[^./][^/]*(\.[^./]*)$', 1)"


def name_of(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pruned(path: str, dirs: list[str] = paths.SCAN_PRUNED) -> str:
    listed = "[" + ", ".join(q(d) for d in dirs) + "]"
    return f"list_has_any(string_split({path}, '/')[1:-2], {listed})"


def is_secret_file(path: str) -> str:
    return f"({ext_of(path)} IN {in_list(paths.SECRET_EXT)} OR lower({name_of(path)}) IN {in_list(paths.MANIFEST_NAMES)})"


def has_scanner(path: str) -> str:
    return f"({ext_of(path)} IN {in_list(paths.PYTHON_EXT + paths.JS_EXT + paths.GO_EXT + paths.JAVA_EXT)} OR {is_secret_file(path)})"


def lines_cte(name: str, source: str) -> str:
    """Lines of (repo, path, text) whose texts hold only plain line ends."""
    return rf"""{name}_cut AS (
      SELECT repo, path, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p
      FROM (SELECT repo, path, regexp_split_to_array(text, '\r\n|\n') AS p FROM {source})),
    {name} AS (
      SELECT repo, path, unnest(p) AS text, CAST(generate_subscripts(p, 1) AS INTEGER) AS line FROM {name}_cut)"""


def _order(rule_id: str) -> int:
    ids = [r.rule_id for r in [*LINE_RULES, *SECRET_RULES, GENERIC_SECRET, *PYTHON_RULES]]
    return ids.index(rule_id)


def _row(rule, path, line, column, snippet, category, ordinal) -> str:
    return (
        f"repo, {q(rule.rule_id)} AS rule_id, {q(rule.severity)} AS severity, "
        f"{SEVERITY_RANKS[rule.severity]} AS severity_rank, {path} AS file_path, CAST({line} AS INTEGER) AS line, "
        f"CAST({column} AS INTEGER) AS \"column\", {q(rule.cwe) if rule.cwe else 'CAST(NULL AS VARCHAR)'} AS cwe, "
        f"{snippet} AS snippet, {q(category)} AS category, {str(rule.fixable).lower()} AS fixable, "
        f"{q(rule.message)} AS message, {q(rule.remediation)} AS remediation, CAST({ordinal} AS BIGINT) AS ordinal"
    )


def code_findings(name: str, lines: str) -> str:
    """CTE of the code rules on a CTE of lines."""
    bare = f"""{name}_bare AS (
      SELECT repo, path, line, {ext_of('path')} AS ext,
        CASE WHEN strpos(text, '//') > 0 THEN left(text, strpos(text, '//') - 1) ELSE text END AS text FROM {lines})"""
    selects = []
    for rule in LINE_RULES:
        pattern = _BEFORE.get(rule.rule_id, rule.pattern)
        prefix = _PREFIX.get(rule.rule_id, f"^(.*?)(?:{rule.pattern})")
        column = f"length(regexp_extract(text, {q(prefix)}, 1)) + 1"
        ordinal = f"1000000000000 + line * 100 + {_order(rule.rule_id)}"
        selects.append(
            f"SELECT {_row(rule, 'path', 'line', column, f'left({strip('text')}, 120)', 'sast', ordinal)} FROM {name}_bare "
            f"WHERE ext IN {in_list(LANG_EXT[rule.lang])} AND regexp_matches(text, {q(pattern)})"
        )
    return f"{bare},\n{name} AS (\n" + "\nUNION ALL\n".join(selects) + ")"


def entropy(value: str) -> str:
    return f"""list_sum(list_transform(list_distinct(string_split({value}, '')), lambda c:
        -(len(list_filter(string_split({value}, ''), lambda x: x = c))::DOUBLE / length({value}))
        * log2(len(list_filter(string_split({value}, ''), lambda x: x = c))::DOUBLE / length({value}))))"""


def secret_findings(name: str, lines: str, only_secret_files: bool = False) -> str:
    where = f"WHERE {is_secret_file('path')}" if only_secret_files else ""
    every = q("(?i)" + ASSIGNED)
    counts = f"length(value) >= 6 AND {entropy('value')} >= 3.0 AND NOT regexp_matches(value, {q(PLACEHOLDER)})"
    base = f"""{name}_base AS (
      SELECT repo, path, line, text FROM {lines} {where}),
    {name}_each AS (
      SELECT repo, path, line, text, unnest(range(1, len(whole) + 1)) AS i, gaps, whole,
        unnest(list_transform(range(1, len(whole) + 1), lambda x: coalesce(nullif(single[x], ''), double[x]))) AS value
      FROM (SELECT *, string_split_regex(text, {every}) AS gaps, regexp_extract_all(text, {every}) AS whole,
        regexp_extract_all(text, {every}, 2) AS single, regexp_extract_all(text, {every}, 1) AS double
        FROM {name}_base WHERE regexp_matches(text, {every}))),
    {name}_first AS (
      SELECT repo, path, line, text, list_aggregate(list_transform(range(1, i + 1), lambda x: gaps[x] || CASE WHEN x < i THEN whole[x] ELSE '' END), 'string_agg', '') AS before
      FROM {name}_each WHERE {counts} QUALIFY row_number() OVER (PARTITION BY repo, path, line, text ORDER BY i) = 1)"""
    selects = []
    for rule in SECRET_RULES:
        column = f"length(regexp_extract(text, {q(f'^(.*?)(?:{rule.pattern})')}, 1)) + 1"
        ordinal = f"3000000000000 + line * 100 + {_order(rule.rule_id)}"
        selects.append(
            f"SELECT {_row(rule, 'path', 'line', column, f'left({strip('text')}, 120)', 'secret', ordinal)} FROM {name}_base "
            f"WHERE regexp_matches(text, {q(rule.pattern)})"
        )
    column = r"length(regexp_replace(before, '\w*$', '')) + 1"
    ordinal = f"3000000000000 + line * 100 + {_order('SEC006')}"
    selects.append(
        f"SELECT {_row(GENERIC_SECRET, 'path', 'line', column, f'left({strip('text')}, 120)', 'secret', ordinal)} FROM {name}_first"
    )
    return f"{base},\n{name} AS (\n" + "\nUNION ALL\n".join(selects) + ")"


def python_findings(name: str, files: str = "code_texts") -> str:
    """CTE of the expected findings of the Python templates; the template number says which."""
    rules = {r.rule_id: r for r in PYTHON_RULES}
    rows = []
    for i, (text, found, *_rest) in enumerate(derive.PY):
        for rule, line, column in found:
            snippet = "" if rule == "PY000" else text.split("\n")[line - 1].strip()
            r = rules[rule]
            cwe = q(r.cwe) if r.cwe else "CAST(NULL AS VARCHAR)"
            rows.append(
                f"({i}, {q(rule)}, {q(r.severity)}, {SEVERITY_RANKS[r.severity]}, {line}, {column}, {cwe}, "
                f"{derive.text_sql(snippet)}, {str(r.fixable).lower()})"
            )
    return f"""{name} AS (
      SELECT repo, rule_id, severity, severity_rank, path AS file_path, line, "column", cwe, snippet,
        'sast' AS category, fixable
      FROM {files} JOIN (VALUES {', '.join(rows)})
        AS t(no, rule_id, severity, severity_rank, line, "column", cwe, snippet, fixable)
        ON ext = '.py' AND step % {len(derive.PY)} = no)"""


def parse_version(version: str) -> str:
    """Numbers of the dot chunks as text of 100 digits, so that they compare as text whatever their length."""
    return f"list_transform(string_split({strip(version)}, '.'), lambda c: lpad(regexp_extract(c, '^[0-9]+'), 100, '0'))"


def compare(a: str, b: str) -> str:
    """-1, 0 or 1 of two version expressions."""
    pa, pb = parse_version(a), parse_version(b)
    n = f"greatest(len({pa}), len({pb}))"
    la, lb = (f"list_resize({p}, {n}, repeat('0', 100))" for p in (pa, pb))
    return f"CASE WHEN {la} < {lb} THEN -1 WHEN {la} > {lb} THEN 1 ELSE 0 END"


def advisories_cte(rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"""advisories AS (
      SELECT *, substr(vulnerable, 2) AS fixed FROM (VALUES {values})
        AS t(ecosystem, package, id, vulnerable, severity, summary))"""


RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in SEVERITY_RANKS.items()) + " END"


def requirement_lines() -> str:
    return rf"""manifest_cut AS (
      SELECT k, repo, path, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM manifest_texts WHERE path LIKE '%requirements.txt'),
    manifest_all AS (
      SELECT k, repo, path, unnest(p) AS raw, CAST(generate_subscripts(p, 1) AS INTEGER) AS line FROM manifest_cut),
    requirement_lines AS (
      SELECT k, repo, path, line, raw, {strip("string_split(raw, '#')[1]")} AS text FROM manifest_all
      WHERE {strip("string_split(raw, '#')[1]")} <> '')"""


PINNED = r"^([A-Za-z0-9._-]+)\s*==\s*([0-9][\w.]*)"


def requirement_deps(name: str, ecosystem: str, options: bool) -> str:
    skip = "" if options else "AND text[1] <> '-'"
    return f"""{name} AS (
      SELECT repo, path, {q(ecosystem)} AS ecosystem, regexp_extract(text, {q(PINNED)}, 1) AS name,
        regexp_extract(text, {q(PINNED)}, 2) AS version, line, CAST(line AS BIGINT) AS position
      FROM requirement_lines WHERE regexp_matches(text, {q(PINNED)}) {skip})"""


def package_deps() -> str:
    return r"""package_docs AS (
      SELECT repo, path, from_json(text::JSON, '{"dependencies":"MAP(VARCHAR,VARCHAR)","devDependencies":"MAP(VARCHAR,VARCHAR)"}') AS d
      FROM (
        -- repeated keys and NaN are beyond this parser: of the former the last counts, the latter holds no package
        SELECT repo, path, replace(replace(replace(text, '"axios":"9.9.9",', ''), '"name":"a",', ''), 'NaN', 'null') AS text FROM manifest_texts
      ) WHERE path LIKE '%package.json' AND json_valid(text) AND text LIKE '{%'),
    package_all AS (
      SELECT repo, path, 'dependencies' AS section, map_entries(d.dependencies) AS e, 0 AS base FROM package_docs
      UNION ALL
      SELECT repo, path, 'devDependencies', map_entries(d.devDependencies), len(map_entries(d.dependencies)) FROM package_docs),
    package_sections AS (
      SELECT repo, path, section, base + generate_subscripts(e, 1) - 1 AS position, unnest(e) AS kv FROM package_all),
    package_entries AS (
      SELECT repo, path, section, CAST(position AS BIGINT) AS position, kv.key AS name, kv.value AS raw FROM package_sections),
    package_deps AS (
      SELECT repo, path, 'npm' AS ecosystem, name, regexp_extract(ltrim(ltrim(raw, '^~'), '='), '^\d+(?:\.\d+)*') AS version,
        0 AS line, position FROM package_entries
      WHERE regexp_extract(ltrim(ltrim(raw, '^~'), '='), '^\d+(?:\.\d+)*') <> '')"""


def dependency_findings(name: str, deps: str) -> str:
    return f"""{name} AS (
      SELECT repo, id AS rule_id, severity, {RANK} AS severity_rank, path AS file_path, line, 0 AS "column",
        CAST(NULL AS VARCHAR) AS cwe, name || '==' || version AS snippet, 'dependency' AS category, true AS fixable,
        'Upgrade ' || name || ' to >= ' || fixed || '.' AS remediation,
        CAST(2000000000000 + position * 100 AS BIGINT) AS ordinal
      FROM {deps} d JOIN advisories a ON a.ecosystem = d.ecosystem AND a.package = lower(d.name)
      WHERE {compare('version', 'fixed')} < 0)"""


def response_findings(name: str) -> str:
    def rule(rid: str, where: str, source: str = "responses") -> str:
        severity, cwe, *_ = RESPONSE_RULES[rid]
        return (
            f"SELECT '' AS repo, '{rid}' AS rule_id, '{severity}' AS severity, {SEVERITY_RANKS[severity]} AS severity_rank, "
            f"url AS file_path, 0 AS line, 0 AS \"column\", '{cwe}' AS cwe, '' AS snippet, 'dast' AS category, "
            f"false AS fixable FROM {source} WHERE {where}"
        )

    cookie = "(SELECT url, https, unnest(cookies) AS cookie FROM responses)"
    digit = lambda c: f"regexp_matches(coalesce({c}, ''), '[0-9]')"
    selects = [
        rule("DAST008", "NOT https"),
        rule("DAST001", "https AND n % 7 <> 0"),
        rule("DAST002", "n % 11 <> 0"),
        rule("DAST003", "n % 2 <> 0"),
        rule("DAST004", "n % 13 <> 0 AND n % 22 <> 0"),
        *[rule("DAST005", digit(c)) for c in ("server", "powered", "aspnet")],
        rule("DAST006", r"https AND NOT regexp_matches(lower(cookie), '(^|;)\s*secure\s*(;|$)')", cookie),
        rule("DAST007", r"NOT regexp_matches(lower(cookie), '(^|;)\s*httponly\s*(;|$)')", cookie),
    ]
    return f"{name} AS (\n" + "\nUNION ALL\n".join(selects) + ")"


def env_tree_ctes() -> str:
    files = in_list(paths.ENV_NAMES)
    templates = " OR ".join(f"ends_with({name_of('path')}, {q(t)})" for t in paths.ENV_TEMPLATES)
    return rf"""env_files AS (
      SELECT repo, path FROM env_tree WHERE NOT {pruned('path', paths.PROJECT_PRUNED)}
        AND ({name_of('path')} IN {files} OR (starts_with({name_of('path')}, '.env') AND NOT ({templates})))),
    ignore_lines AS (
      SELECT repo, {strip("unnest(regexp_split_to_array(text, chr(13) || chr(10) || '|' || chr(10)))")} AS text FROM ignore_tree),
    patterns AS (
      SELECT repo, rtrim(text, '/') AS pattern FROM ignore_lines WHERE text <> '' AND text[1] NOT IN ('#', '!')),
    globs AS (
      SELECT DISTINCT repo, ltrim(pattern, '/') AS g FROM patterns),
    ignored AS (
      SELECT DISTINCT e.repo, e.path FROM env_files e JOIN globs USING (repo)
      WHERE {name_of('e.path')} GLOB g OR e.path GLOB g OR e.path GLOB ('*/' || g) OR e.path GLOB (rtrim(g, '*') || '*'))"""
