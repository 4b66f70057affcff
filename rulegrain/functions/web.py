"""Expressions over URLs, headers and cookies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import py_strip


def url_scheme(url: Column) -> Column:
    """Lower-cased scheme, '' for a relative URL."""
    cleaned = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.lower(F.regexp_extract(cleaned, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def header(headers: Column, name: str) -> Column:
    """Value of a header whatever its case; the last one wins; null when absent."""
    same = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(same, F.lit(-1))["value"]


def cookie_flags(cookie: Column) -> Column:
    return F.array_distinct(F.transform(F.split(cookie, ";"), lambda part: F.lower(py_strip(part))))


def cookie_name(cookie: Column) -> Column:
    return py_strip(F.substring_index(cookie, "=", 1))
