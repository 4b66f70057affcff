"""Queries over sources and what is read of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import paths
from ...operators import dependencies as deps, findings as algebra, lines, osv, project, responses
from ...operators.pyfacts import py_facts, python_errors, python_sources
from ...sources import corpus as source
from .. import derive, oracle as o
from .registry import query

CODE = derive.code_texts_sql()
MANIFESTS = derive.manifest_texts_sql()


@query("corpus_inventory", o.with_(CODE, "SELECT repo, path, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM code_texts"))
def corpus_inventory(spark, sf_dir):
    return source.corpus_inventory(derive.code_corpus(spark, sf_dir))


@query("prune_ignored_dirs", o.with_(CODE, f"SELECT repo, path FROM code_texts WHERE NOT {o.pruned('path')}"))
def prune_ignored_dirs(spark, sf_dir):
    return source.prune_ignored_dirs(derive.code_corpus(spark, sf_dir)).select("repo", "path")


@query(
    "size_cap",
    """SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(floor(o_totalprice * 10) AS BIGINT) AS length FROM orders
       WHERE floor(o_totalprice * 10) <= 2000000""",
)
def size_cap(spark, sf_dir):
    sizes = derive.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("path"), F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("length")
    )
    return source.size_cap(sizes)


def _dispatch_sql(files: str) -> str:
    ext = o.ext_of("path")
    cases = [
        (f"{ext} IN {o.in_list(paths.PYTHON_EXT)}", "python"),
        (f"{ext} IN {o.in_list(paths.JS_EXT)}", "js"),
        (f"{ext} IN {o.in_list(paths.GO_EXT)}", "go"),
        (f"{ext} IN {o.in_list(paths.JAVA_EXT)}", "java"),
        (f"lower({o.name_of('path')}) IN {o.in_list(paths.MANIFEST_NAMES)}", "dependency"),
        (o.is_secret_file("path"), "secret"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in cases)
    return f"""SELECT repo, path, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS scanner_no, unnest(s) AS scanner
      FROM (SELECT repo, path, list_filter([{listed}], lambda x: x IS NOT NULL) AS s FROM ({files}))"""


@query(
    "scanner_dispatch",
    o.with_(CODE, MANIFESTS, _dispatch_sql("SELECT repo, path FROM code_texts UNION ALL SELECT repo, path FROM manifest_texts")),
)
def scanner_dispatch(spark, sf_dir):
    files = derive.code_corpus(spark, sf_dir).unionByName(derive.manifest_corpus(spark, sf_dir))
    return source.scanner_dispatch(files)


@query(
    "scanned_files",
    o.with_(
        CODE,
        f"""SELECT repo, count(*) AS scanned_files FROM code_texts
            WHERE NOT {o.pruned('path')} AND {o.has_scanner('path')} GROUP BY repo""",
    ),
)
def scanned_files(spark, sf_dir):
    return source.scanned_files(derive.code_corpus(spark, sf_dir))


@query("code_lines", o.with_(derive.document_lines_sql(), "SELECT repo, path, line, text FROM document_lines"))
def code_lines(spark, sf_dir):
    return lines.code_lines(derive.document_texts(spark, sf_dir)).select("repo", "path", "line", "text")


@query(
    "comment_strip",
    o.with_(
        derive.unique_lines_sql(),
        f"""SELECT repo, path, line, text FROM (
              SELECT repo, path, line, CASE WHEN strpos(text, '//') > 0 THEN left(text, strpos(text, '//') - 1) ELSE text END AS text
              FROM unique_lines) WHERE {o.strip('text')} <> ''""",
    ),
)
def comment_strip(spark, sf_dir):
    return lines.comment_strip(derive.unique_lines(spark, sf_dir)).select("repo", "path", "line", "text")


@query(
    "manifest_lines",
    o.with_(MANIFESTS, o.requirement_lines(), "SELECT repo, path, line, text FROM requirement_lines WHERE text[1] <> '-'"),
)
def manifest_lines(spark, sf_dir):
    return deps.manifest_lines(derive.manifest_corpus(spark, sf_dir)).select("repo", "path", "line", "text")


DEP_COLUMNS = ["repo", "path", "ecosystem", "name", "version", "line"]


@query(
    "requirements_deps",
    o.with_(
        MANIFESTS, o.requirement_lines(), o.requirement_deps("d", "pypi", False),
        f"SELECT {', '.join(DEP_COLUMNS)} FROM d",
    ),
)
def requirements_deps(spark, sf_dir):
    return deps.requirements_deps(deps.manifest_lines(derive.manifest_corpus(spark, sf_dir))).select(*DEP_COLUMNS)


@query("package_json_deps", o.with_(MANIFESTS, o.package_deps(), f"SELECT {', '.join(DEP_COLUMNS)} FROM package_deps"))
def package_json_deps(spark, sf_dir):
    return deps.package_json_deps(derive.manifest_corpus(spark, sf_dir)).select(*DEP_COLUMNS)


@query("dep_sections_union", o.with_(MANIFESTS, o.package_deps(), "SELECT repo, path, section, position, name, raw FROM package_entries"))
def dep_sections_union(spark, sf_dir):
    return deps.package_json_sections(derive.manifest_corpus(spark, sf_dir)).select(
        "repo", "path", "section", "position", "name", "raw"
    )


@query(
    "extract_dependencies",
    o.with_(
        MANIFESTS, o.requirement_lines(), o.requirement_deps("d", "PyPI", True), o.package_deps(),
        f"SELECT {', '.join(DEP_COLUMNS)} FROM d UNION ALL SELECT {', '.join(DEP_COLUMNS)} FROM package_deps",
    ),
)
def extract_dependencies(spark, sf_dir):
    return deps.extract_dependencies(derive.manifest_corpus(spark, sf_dir)).select(*DEP_COLUMNS)


@query(
    "advisory_table",
    o.with_(
        derive.dependency_rows_sql(), o.advisories_cte(deps.ADVISORIES),
        """SELECT ecosystem, package, id, vulnerable, fixed, severity, vulnerable[1] AS op,
             coalesce(n, 0) AS dependencies FROM advisories
           LEFT JOIN (SELECT lower(name) AS package, count(*) AS n FROM dependency_rows GROUP BY 1) USING (package)""",
    ),
)
def advisory_table(spark, sf_dir):
    named = derive.dependency_rows(spark, sf_dir).groupBy(F.lower("name").alias("package")).agg(F.count("*").alias("n"))
    joined = deps.advisory_table(spark).join(named, "package", "left")
    return joined.select(
        "ecosystem", "package", "id", "vulnerable", "fixed", "severity", "op", F.coalesce("n", F.lit(0)).cast("bigint").alias("dependencies")
    )


_FEED_SQL = """SELECT ecosystem, name, version, 0 AS vuln_no, 'GHSA-' || (last % 50) AS id,
    CASE WORD WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 5 THEN 'HIGH'
      ELSE CASE (m + last) % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 4 THEN 'MEDIUM' ELSE 'HIGH' END END AS severity,
    CASE last % 4 WHEN 0 THEN 'First line' WHEN 3 THEN 'Plain' ELSE 'Details here' END AS summary,
    CASE WHEN last % 3 <> 0 THEN (last + 1) || '.0' END AS fixed
  FROM (SELECT *, (n + last) % 6 AS WORD FROM replies) WHERE last % 8 <> 7
  UNION ALL
  SELECT ecosystem, name, version, 1, 'CVE-2020-14343', 'MEDIUM', 'Known vulnerability.', CAST(NULL AS VARCHAR)
  FROM replies WHERE last % 8 <> 7"""


def feed_cte() -> str:
    return f"feed AS ({_FEED_SQL})"


@query("osv_feed", o.with_(derive.dependency_rows_sql(), derive.replies_sql(), _FEED_SQL))
def osv_feed(spark, sf_dir):
    return osv.osv_feed(derive.replies(spark, sf_dir))


@query("gitignore_patterns", o.with_(derive.tree_sql(), o.env_tree_ctes(), "SELECT repo, pattern FROM patterns"))
def gitignore_patterns(spark, sf_dir):
    return project.gitignore_patterns(derive.tree_files(spark, sf_dir))


@query("env_files", o.with_(derive.tree_sql(), o.env_tree_ctes(), "SELECT repo, path FROM env_files"))
def env_files(spark, sf_dir):
    return project.env_files(derive.tree_files(spark, sf_dir))


@query(
    "response_log",
    o.with_(
        derive.responses_sql(),
        """SELECT url, 200 AS status, https AS is_https, CASE WHEN n % 7 = 0 THEN 'max-age=1' END AS hsts,
             CASE WHEN n % 22 = 0 THEN 'Frame-Ancestors ''none''' WHEN n % 11 = 0 THEN 'default-src ''self''' END AS csp,
             CASE WHEN n % 2 = 0 THEN 'NoSniff' END AS sniffing, CASE WHEN n % 13 = 0 THEN 'DENY' END AS framing,
             server, powered, aspnet, CAST(len(cookies) AS INTEGER) AS n_cookies FROM responses""",
    ),
)
def response_log(spark, sf_dir):
    log = responses.response_log(derive.responses(spark, sf_dir))
    named = [F.col("versions")[i]["value"].alias(n) for i, n in enumerate(["server", "powered", "aspnet"])]
    return log.select("url", "status", "is_https", "hsts", "csp", "sniffing", "framing", *named, F.size("cookies").alias("n_cookies"))


@query(
    "suppression_tables",
    o.with_(
        derive.configs_sql(),
        """SELECT repo, 'rule' AS kind, unnest(ignore_rules) AS value FROM configs
           UNION ALL SELECT repo, 'path', unnest(ignore_paths) FROM configs
           UNION ALL SELECT repo, 'fail_on', upper(fail_on) FROM configs WHERE fail_on <> ''""",
    ),
)
def suppression_tables(spark, sf_dir):
    rules, globs, gates = algebra.suppression_tables(derive.configs(spark, sf_dir))
    return (
        rules.select("repo", F.lit("rule").alias("kind"), F.col("rule_id").alias("value"))
        .unionByName(globs.select("repo", F.lit("path").alias("kind"), F.col("pattern").alias("value")))
        .unionByName(gates.select("repo", F.lit("fail_on").alias("kind"), F.col("fail_on").alias("value")))
    )


@query(
    "scan_errors",
    o.with_(
        MANIFESTS, CODE,
        """SELECT repo, path AS file_path, 'dependency scan failed: not a table of packages' AS error FROM manifest_texts
             WHERE text = '[1, 2]'
           UNION ALL SELECT '', 'f' || o_orderkey, 'path not found: f' || o_orderkey FROM orders
             WHERE 'f' || o_orderkey NOT IN (SELECT path FROM code_texts)""",
    ),
)
def scan_errors(spark, sf_dir):
    manifests = derive.manifest_corpus(spark, sf_dir)
    code = derive.code_corpus(spark, sf_dir)
    roots = derive.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("root"), F.lit(0).alias("root_ordinal")
    )
    return (
        deps.manifest_errors(manifests)
        .unionByName(python_errors(py_facts(python_sources(code))))
        .unionByName(algebra.missing_roots(code, roots))
    )


@query(
    "unreadable_files",
    o.with_(
        CODE,
        """SELECT repo, path AS file_path, 'LOW' AS severity,
             CASE ext WHEN '.py' THEN 'PY000' WHEN '.go' THEN 'GO000' WHEN '.java' THEN 'JAVA000' ELSE 'JS000' END AS rule_id
           FROM code_texts WHERE (ext IN ('.js', '.ts', '.mjs', '.go', '.java', '.py') AND k % 13 = 0)
             OR (ext = '.py' AND k % 17 = 0)""",
    ),
)
def unreadable_files(spark, sf_dir):
    return lines.unreadable_files(derive.broken_corpus(spark, sf_dir)).select("repo", "file_path", "severity", "rule_id")
