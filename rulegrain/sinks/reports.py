"""Reports as ordered text rows.

A report of one repository may hold a large share of all findings, so no document is ever built in
one place: each row is a piece of text, and the rows in order are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import __version__
from ..operators.findings import severity_columns
from ..operators.joins import salted_join
from ..schema import SEVERITY_RANKS, sarif_level

ORDER = ["repo", "section", "minus_rank", "file_path", "line", "rule_id", "column", "ordinal"]

# The SARIF version and its schema.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

_JSON = {"ignoreNullFields": "false"}


def _rows(df: DataFrame, section: int, text: Column) -> DataFrame:
    """Report rows; columns of the order that a section lacks stay empty."""
    have = set(df.columns)
    kinds = {"file_path": "string", "rule_id": "string", "ordinal": "bigint"}
    out = [F.col("repo"), F.lit(section).alias("section")]
    for name in ORDER[2:]:
        kind = kinds.get(name, "int")
        if name == "minus_rank":
            value = -F.col("severity_rank") if "severity_rank" in have else F.lit(None)
        else:
            value = F.col(f"`{name}`") if name in have else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out, text.alias("text"))


def _summaries(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per repository: files scanned and findings per level, zeros included."""
    counts = findings.groupBy("repo").agg(*severity_columns())
    joined = stats.select("repo", "scanned_files").join(counts, "repo", "full_outer")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ["scanned_files", *SEVERITY_RANKS]]
    return joined.select("repo", *zero)


def _frame(heads: DataFrame, texts: dict[int, Column]) -> DataFrame:
    """One row per repository for each section number: what stands around the listed rows."""
    parts = F.array(*[F.struct(F.lit(section).alias("section"), text.alias("text")) for section, text in texts.items()])
    return _rows_of(heads.select("repo", F.inline(parts)))


def _rows_of(rows: DataFrame) -> DataFrame:
    """Rows (repo, section, text) with the columns of the order that they lack."""
    kinds = {"file_path": "string", "rule_id": "string", "ordinal": "bigint"}
    empty = [F.lit(None).cast(kinds.get(name, "int")).alias(name) for name in ORDER[2:]]
    return rows.select("repo", F.col("section").cast("int").alias("section"), *empty, "text")


def _separated(rows: DataFrame) -> DataFrame:
    """Put a comma before every row but the first of its repository and section; equal rows are listed once.

    The first is the least in report order, then by its text, so that there is exactly one.
    """
    rows = rows.distinct()
    key = F.struct(*ORDER[2:], "text")
    first = rows.groupBy("repo").agg(F.min(key).alias("least"))
    joined = salted_join(rows, first, ["repo"], "inner", [F.col("file_path"), F.col("ordinal")])
    text = F.when(key == F.col("least"), F.col("text")).otherwise(F.concat(F.lit(","), F.col("text")))
    return joined.withColumn("text", text).drop("least")


def finding_json() -> Column:
    """One finding as a JSON object, absent values included."""
    same = ["message", "line", "column", "cwe", "category", "fixable", "remediation", "snippet"]
    fields = {"rule_id": "rule_id", "severity": "severity", "message": "message", "file": "file_path"}
    fields |= {n: n for n in same}
    order = ["rule_id", "severity", "message", "file", "line", "column", "cwe", "category", "fixable", "remediation", "snippet"]
    return F.to_json(F.struct(*[F.col(f"`{fields[n]}`").alias(n) for n in order]), _JSON)


def _json_string(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def report_json(findings: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """A JSON document per repository: head, findings, errors, tail. Equal findings count once."""
    findings = findings.distinct()
    heads = _summaries(findings, stats)
    summary = F.to_json(F.struct(*SEVERITY_RANKS))
    head = F.concat(
        F.lit(f'{{"tool":"rulegrain","version":"{__version__}","scanned_files":'), F.col("scanned_files"),
        F.lit(',"summary":'), summary, F.lit(',"findings":['),
    )
    listed = errors.select("repo", "file_path", "error").distinct().withColumn("rule_id", F.col("error"))
    return (
        _frame(heads, {0: head, 2: F.lit('],"errors":['), 4: F.lit("]}")})
        .unionByName(_separated(_rows(findings, 1, finding_json())))
        .unionByName(_separated(_rows(listed, 3, _json_string(F.col("error")))))
    )


def sarif_result() -> Column:
    region = F.struct(
        F.greatest(F.col("line"), F.lit(1)).alias("startLine"), F.greatest(F.col("column"), F.lit(1)).alias("startColumn")
    )
    place = F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            sarif_level(F.col("severity")).alias("level"),
            F.struct(F.col("message").alias("text")).alias("message"),
            F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        )
    )


def report_sarif(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """A SARIF document per repository: one run, one result per finding. Equal findings count once."""
    findings = findings.distinct()
    heads = _summaries(findings, stats)
    head = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"rulegrain",'
        f'"version":"{__version__}","informationUri":"https://example.local/rulegrain","rules":[]}}}},"results":['
    )
    return (
        _frame(heads, {0: F.lit(head), 2: F.lit("]}]}")})
        .unionByName(_separated(_rows(findings, 1, sarif_result())))
    )


def finding_location() -> Column:
    return F.concat(F.col("file_path"), F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line"))).otherwise(""))


def listing_text() -> Column:
    """One finding as a block of lines: place, rule with level and weakness, then what it says."""
    cwe = F.coalesce(F.concat(F.lit(", "), F.nullif(F.col("cwe"), F.lit(""))), F.lit(""))
    return F.concat(
        finding_location(), F.lit("\n  "), F.col("rule_id"), F.lit(" ("), F.lower("severity"), cwe,
        F.when(F.col("fixable"), ", has a fix").otherwise(""), F.lit("): "), F.col("message"),
        F.when(F.col("snippet") != "", F.concat(F.lit("\n  | "), F.col("snippet"))).otherwise(""),
        F.when(F.col("remediation") != "", F.concat(F.lit("\n  -> "), F.col("remediation"))).otherwise(""),
    )


def report_listing(findings: DataFrame, stats: DataFrame, errors: DataFrame) -> DataFrame:
    """A plain text report per repository: a head with the counts, a block per finding, unread files, an end line.

    Equal findings count once.
    """
    findings = findings.distinct()
    heads = _summaries(findings, stats)
    levels = sorted(SEVERITY_RANKS, key=SEVERITY_RANKS.get, reverse=True)
    total = sum((F.col(s) for s in SEVERITY_RANKS), F.lit(0))
    counts = F.concat_ws(", ", *[F.concat(F.col(s).cast("string"), F.lit(f" {s.lower()}")) for s in levels])
    head = F.concat(
        F.lit("Repository "), F.col("repo"), F.lit(": "), F.col("scanned_files"), F.lit(" files read, "),
        total.cast("string"), F.lit(" findings ("), counts, F.lit(")"),
    )
    listed = errors.select("repo", "file_path", "error").withColumn("rule_id", F.col("error"))
    return (
        _frame(heads, {0: head, 3: F.concat(F.lit("End of "), F.col("repo"))})
        .unionByName(_rows(findings, 1, listing_text()))
        .unionByName(_rows(listed, 2, F.concat(F.lit("not read: "), F.col("file_path"), F.lit(" - "), F.col("error"))))
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write report rows in order; a repository's part files, by name, make up its document."""
    ordered = report.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in ORDER])
    ordered.select("repo", "text").write.partitionBy("repo").mode("errorifexists").text(path)
