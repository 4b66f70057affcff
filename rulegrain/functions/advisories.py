"""Expressions over advisory replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import lookup
from .once import let
from .text import LINE_ENDS, py_strip

# Severity words of advisory replies.
SEVERITY_WORDS = {
    "CRITICAL": "CRITICAL", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW",
}

DEFAULT_SUMMARY = "Known vulnerability."

REPLY_SCHEMA = """vulns array<struct<
    id: string, summary: string, details: string,
    database_specific: struct<severity: string>,
    severity: array<struct<type: string, score: string>>,
    affected: array<struct<
        package: struct<name: string, ecosystem: string>,
        ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>>>>>"""


def score_value(score: Column) -> Column:
    """Number left after dropping all but digits and dots; 0 where that is no number."""
    digits = F.regexp_replace(F.coalesce(score, F.lit("")), "[^0-9.]", "")
    return F.coalesce(digits.try_cast("double"), F.lit(0.0))


def first_score(severity: Column) -> Column:
    """The first score of at least 4, which decides; null when there is none."""
    scores = F.transform(severity, lambda s: score_value(s["score"]))
    return F.get(F.filter(scores, lambda v: v >= 4.0), F.lit(0))


def advisory_severity(word: Column, severity: Column) -> Column:
    ranked = let(
        first_score(severity),
        lambda score: F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH").otherwise("MEDIUM"),
    )
    return F.coalesce(lookup(SEVERITY_WORDS, F.upper(word)), ranked)


def advisory_summary(summary: Column, details: Column) -> Column:
    """First line of summary or details, at most 200 characters."""
    text = py_strip(F.coalesce(F.nullif(summary, F.lit("")), F.nullif(details, F.lit("")), F.lit(DEFAULT_SUMMARY)))
    first = F.get(F.split(text, LINE_ENDS, 2), F.lit(0))
    return F.coalesce(F.nullif(F.substring(first, 1, 200), F.lit("")), F.lit(DEFAULT_SUMMARY))


def first_fixed(affected: Column, name: Column) -> Column:
    """First fixed event among the affected entries of the same package."""
    mine = F.filter(affected, lambda a: F.lower(F.coalesce(a["package"]["name"], F.lit(""))) == F.lower(name))
    ranges = F.flatten(F.transform(mine, lambda a: F.coalesce(a["ranges"], F.array())))
    events = F.flatten(F.transform(ranges, lambda r: F.coalesce(r["events"], F.array())))
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull())
    return F.get(fixed, F.lit(0))
