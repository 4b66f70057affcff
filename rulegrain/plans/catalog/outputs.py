"""Queries over reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators.findings import union_scanners
from ...operators import dependencies as deps, project
from ...operators.lines import scan_code
from ...sinks import reports
from ...sources.corpus import scannable, scanned_files
from ...sources.tables import shared_folder, stored
from ...streaming import streams
from .. import derive, oracle as o
from .registry import query, shown
from .rules import DEP_FINDINGS, PRJ

CODE = derive.code_texts_sql()
COUNTS = """counts AS (
      SELECT s.repo, scanned_files, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high, coalesce(critical, 0) AS critical
      FROM (SELECT repo, count(*) AS scanned_files FROM every_file GROUP BY repo) s
      LEFT JOIN (SELECT repo, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium,
          count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'CRITICAL') AS critical FROM f GROUP BY repo) c
        ON c.repo = s.repo)"""
REPORT = [
    CODE,
    derive.manifest_texts_sql(),
    f"scanned AS (SELECT repo, path, text FROM code_texts WHERE NOT {o.pruned('path')} AND {o.has_scanner('path')})",
    f"every_file AS (SELECT repo, path FROM scanned UNION ALL SELECT repo, path FROM manifest_texts)",
    o.lines_cte("file_lines", "scanned"),
    o.code_findings("f", "file_lines"),
    COUNTS,
    "errors AS (SELECT repo, path AS file_path, 'dependency scan failed: not a table of packages' AS error FROM manifest_texts WHERE text = '[1, 2]')",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY severity_rank DESC, file_path, line, rule_id, "column", ordinal) AS no FROM f)""",
    "listed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path, error) AS no FROM errors)",
]


def report_inputs(spark, sf_dir):
    files = derive.code_corpus(spark, sf_dir).unionByName(derive.manifest_corpus(spark, sf_dir))
    found = scan_code(scannable(files))
    return stored(found.unionByName(found.where("line % 2 = 0"))), scanned_files(files), deps.manifest_errors(files)


REPORT_COLUMNS = ["repo", "section", "file_path", "line", "rule_id", "text"]
_HEAD = "SELECT repo, {} AS section, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS rule_id, {} AS text FROM {}"


@query(
    "report_json",
    o.with_(
        *REPORT,
        _HEAD.format(
            0,
            """'{"tool":"rulegrain","version":"0.1.0","scanned_files":' || scanned_files || ',"summary":{"LOW":' || low || ',"MEDIUM":'
               || medium || ',"HIGH":' || high || ',"CRITICAL":' || critical || '},"findings":['""",
            "counts",
        )
        + """ UNION ALL SELECT repo, 1, file_path, line, rule_id, CASE WHEN no > 1 THEN ',' ELSE '' END || CAST(to_json({'rule_id': rule_id,
               'severity': severity, 'message': message, 'file': file_path, 'line': line, 'column': "column", 'cwe': cwe, 'category': category,
               'fixable': fixable, 'remediation': remediation, 'snippet': snippet}) AS VARCHAR) FROM ranked
             UNION ALL """
        + _HEAD.format(2, """'],"errors":['""", "counts")
        + """ UNION ALL SELECT repo, 3, file_path, NULL, error, CASE WHEN no > 1 THEN ',' ELSE '' END || '"' || error || '"' FROM listed UNION ALL """
        + _HEAD.format(4, "']}'", "counts"),
    ),
)
def report_json(spark, sf_dir):
    return reports.report_json(*report_inputs(spark, sf_dir)).select(*REPORT_COLUMNS)


@query(
    "report_sarif",
    o.with_(
        *REPORT,
        _HEAD.format(
            0,
            """'{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"rulegrain","version":"0.1.0","informationUri":"https://example.local/rulegrain","rules":[]}},"results":['""",
            "counts",
        )
        + """ UNION ALL SELECT repo, 1, file_path, line, rule_id, CASE WHEN no > 1 THEN ',' ELSE '' END || CAST(to_json({'ruleId': rule_id,
               'level': CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END, 'message': {'text': message},
               'locations': [{'physicalLocation': {'artifactLocation': {'uri': file_path},
                 'region': {'startLine': greatest(line, 1), 'startColumn': greatest("column", 1)}}}]}) AS VARCHAR) FROM ranked
             UNION ALL """
        + _HEAD.format(2, "']}]}'", "counts"),
    ),
)
def report_sarif(spark, sf_dir):
    found, stats, _ = report_inputs(spark, sf_dir)
    return reports.report_sarif(found, stats).select(*REPORT_COLUMNS)


@query(
    "report_listing",
    o.with_(
        *REPORT,
        _HEAD.format(
            0,
            """'Repository ' || repo || ': ' || scanned_files || ' files read, ' || (low + medium + high + critical) || ' findings ('
               || critical || ' critical, ' || high || ' high, ' || medium || ' medium, ' || low || ' low)'""",
            "counts",
        )
        + """ UNION ALL SELECT repo, 1, file_path, line, rule_id,
               file_path || ':' || line || chr(10) || '  ' || rule_id || ' (' || lower(severity) || ', ' || cwe
               || CASE WHEN fixable THEN ', has a fix' ELSE '' END || '): ' || message || chr(10) || '  | ' || snippet
               || chr(10) || '  -> ' || remediation FROM ranked
             UNION ALL SELECT repo, 2, file_path, NULL, error, 'not read: ' || file_path || ' - ' || error FROM errors UNION ALL """
        + _HEAD.format(3, "'End of ' || repo", "counts"),
    ),
)
def report_listing(spark, sf_dir):
    return reports.report_listing(*report_inputs(spark, sf_dir)).select(*REPORT_COLUMNS)


# ---- streams --------------------------------------------------------------------------------------------


def stream_table(spark, sf_dir, name):
    """One provided table as a file stream, be it one file or a folder of files.

    A pattern that only the table's own name fits: a plain path is taken for the folder of partitions,
    which a file cannot be, and a filter of names would leave out the files inside a folder.
    """
    schema = derive.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_scan", o.with_(derive.document_lines_sql(), o.secret_findings("f", "document_lines"), f"SELECT {o.FINDING} FROM f"))
def stream_scan(spark, sf_dir):
    texts = stream_table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text"
    )
    return shown(streams.run_scan(texts))


def arrivals(spark, rows, work, before=lambda batch: None):
    """Runs ``work`` on a stream over a folder after each arrival of rows (..., batch); gives what it gave last."""
    rows, folder, found = stored(rows), shared_folder(spark), None
    for batch in range(derive.ARRIVALS):
        before(batch)
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(folder)
        found = work(spark.readStream.schema(rows.drop("batch").schema).parquet(folder))
    return found


def events(spark, sf_dir):
    return derive.arriving(derive.table(spark, sf_dir, "events"))


def deduped(spark, sf_dir):
    state = shared_folder(spark)
    hours = f"{derive.DELAY_HOURS} hours", f"{derive.SPAN_HOURS} hours"
    return arrivals(spark, events(spark, sf_dir), lambda stream: streams.run_dedupe(stream, *hours, folder=state))


DEDUPED = ["rule_id", "file_path", "line", "column", "ordinal", "root_ordinal", "copies"]
_DEDUPED = 'rule_id, file_path, line, "column"'


@query(
    "stream_dedupe",
    o.with_(
        derive.arriving_sql(),
        f"""SELECT {_DEDUPED}, arg_min(ordinal, (root_ordinal, ordinal)) AS ordinal, min(root_ordinal) AS root_ordinal, count(*) AS copies
            FROM judged WHERE NOT late AND span + {derive.SPAN_HOURS * 3_600_000} <= (SELECT max(mark) FROM marks) GROUP BY {_DEDUPED}, span""",
    ),
)
def stream_dedupe(spark, sf_dir):
    """Firsts of all spans that are over, after several arrivals; what a later one brings back is there again."""
    return deduped(spark, sf_dir).where("NOT late").select(*DEDUPED)


@query(
    "stream_dedupe_late",
    o.with_(derive.arriving_sql(), f"SELECT {_DEDUPED}, count(*) AS copies FROM judged WHERE late GROUP BY {_DEDUPED}"),
)
def stream_dedupe_late(spark, sf_dir):
    """Rows whose span was over when they arrived, by key."""
    late = deduped(spark, sf_dir).where("late")
    return late.groupBy("rule_id", "file_path", "line", "column").agg(F.sum("copies").alias("copies"))


@query("stream_severity", o.with_(derive.timed_sql(), "SELECT date_trunc('hour', ts) AS window_start, severity, count(*) AS n FROM timed GROUP BY ALL"))
def stream_severity(spark, sf_dir):
    counts = streams.run_severity(derive.timed(stream_table(spark, sf_dir, "events")))
    return counts.select(derive.wall_clock("window_start"), "severity", "n")


@query(
    "stream_gate",
    o.with_(
        derive.arriving_sql(),
        f"ranked AS (SELECT batch, {o.RANK} AS severity_rank FROM (SELECT batch, {derive.EVENT_SEVERITY_SQL} AS severity FROM arriving))",
        """SELECT count(*) AS findings, CAST(max(severity_rank) AS INTEGER) AS worst, CASE WHEN max(severity_rank) >= 4 THEN 2 ELSE 0 END AS exit_code
           FROM ranked GROUP BY batch""",
    ),
)
def stream_gate(spark, sf_dir):
    """One row for each arrival."""
    state = shared_folder(spark)
    return arrivals(spark, events(spark, sf_dir), lambda stream: streams.stream_gate(stream, "CRITICAL", state)).drop("batch")


@query("stream_responses", o.with_(derive.responses_sql(), o.response_findings("f"), f"SELECT {o.FINDING} FROM f"))
def stream_responses(spark, sf_dir):
    state = shared_folder(spark)
    rows = derive.responses(spark, sf_dir)
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("url"), F.lit(derive.ARRIVALS)).cast("int"))
    return shown(arrivals(spark, rows, lambda stream: streams.run_responses(stream, state)))


#: Advisories that are known from the first arrival on; the others come before the second.
EARLY = 5
_BATCH = f"CAST(regexp_extract({{}}, '^svc([0-9]+)/', 1) AS BIGINT) % {derive.ARRIVALS}"


@query(
    "stream_dependencies",
    o.with_(
        *DEP_FINDINGS,
        f"SELECT {o.FINDING} FROM dep_f WHERE {_BATCH.format('file_path')} > 0 OR rule_id IN {o.in_list([a[2] for a in deps.ADVISORIES[:EARLY]])}",
    ),
)
def stream_dependencies(spark, sf_dir):
    """Manifests against an advisory table that grows between arrivals."""
    state, table = shared_folder(spark), shared_folder(spark)
    known = deps.advisory_table(spark)
    early = F.col("id").isin([a[2] for a in deps.ADVISORIES[:EARLY]])

    def publish(batch):
        if batch < 2:
            known.where(early if batch == 0 else ~early).write.mode("append").parquet(table)

    rows = derive.manifest_corpus(spark, sf_dir)
    rows = rows.withColumn("batch", (F.regexp_extract("path", "^svc([0-9]+)/", 1).cast("bigint") % derive.ARRIVALS).cast("int"))
    work = lambda batch: streams.batch_dependencies(batch, lambda: spark.read.schema(known.schema).parquet(table))
    return shown(arrivals(spark, rows, lambda stream: streams.run_batches(stream, work, state), publish))


@query("stream_project", PRJ)
def stream_project(spark, sf_dir):
    """Environment files against the index and the ignore lines, as the batch finds them."""
    state, index, lines_ = shared_folder(spark), shared_folder(spark), shared_folder(spark)
    tree = derive.tree_files(spark, sf_dir)
    derive.tracked(spark, sf_dir).write.parquet(index)
    project.gitignore_patterns(tree).write.parquet(lines_)
    rows = tree.withColumn("batch", F.pmod(F.xxhash64("repo", "path"), F.lit(derive.ARRIVALS)).cast("int"))
    work = lambda batch: streams.batch_project(batch, lambda: spark.read.parquet(index), lambda: spark.read.parquet(lines_))
    found = arrivals(spark, rows, lambda stream: streams.run_batches(stream, work, state))
    return found.select("repo", "file_path", "rule_id", "severity", "cwe", "category")
