"""The findings row and the constants every operator shares."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Severity labels and their ranks.
SEVERITY_RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# SARIF level per severity label.
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}

FINDING_COLUMNS = {
    "repo": "string",
    "rule_id": "string",
    "severity": "string",
    "severity_rank": "int",
    "message": "string",
    "file_path": "string",
    "line": "int",
    "column": "int",
    "cwe": "string",
    "snippet": "string",
    "category": "string",
    "fixable": "boolean",
    "remediation": "string",
    "ordinal": "bigint",
}

ERROR_COLUMNS = {"repo": "string", "file_path": "string", "error": "string"}

# Position of each scanner's rows inside one file; project checks come first.
SCANNER_ORDER = {"project": 0, "code": 1, "dependency": 2, "secret": 3, "osv": 4}


def lookup(mapping: dict[str, object], key: Column, default: object = None) -> Column:
    """Constant map lookup; absent keys give ``default``."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(label: Column) -> Column:
    return lookup(SEVERITY_RANKS, label)


def sarif_level(label: Column) -> Column:
    return lookup(SARIF_LEVELS, label, "warning")


def ordinal(scanner: str | Column, position: Column, rule_order: Column | int = 0) -> Column:
    """Rank of a finding inside its file: scanner, then position, then rule."""
    rank = rule_order if isinstance(rule_order, Column) else F.lit(rule_order)
    order = scanner if isinstance(scanner, Column) else F.lit(SCANNER_ORDER[scanner])
    return (
        order.cast("bigint") * F.lit(10**12)
        + position.cast("bigint") * F.lit(100)
        + rank.cast("bigint")
    )


def as_findings(df: DataFrame) -> DataFrame:
    """Fill the defaults, derive the rank and fix order and types of the columns."""
    defaults = {
        "repo": F.lit(""),
        "line": F.lit(0),
        "column": F.lit(0),
        "cwe": F.lit(None),
        "snippet": F.lit(""),
        "category": F.lit("sast"),
        "fixable": F.lit(False),
        "remediation": F.lit(""),
        "ordinal": F.lit(0),
    }
    have = set(df.columns)
    out = []
    for name, kind in FINDING_COLUMNS.items():
        if name == "severity_rank":
            value = severity_rank(F.col("severity"))
        elif name in have:
            value = F.col(f"`{name}`")
        else:
            value = defaults[name]
        out.append(value.cast(kind).alias(name))
    return df.select(*out)
