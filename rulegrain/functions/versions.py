"""Version strings as comparable arrays, and the specifiers that test them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .once import let
from .text import jvm_pattern, py_strip

# Manifest and specifier shapes.
PINNED = r"^([A-Za-z0-9._-]+)\s*==\s*([0-9][\w.]*)"
SPECIFIER = r"^\s*(<=|>=|<|>|==)\s*(.+)"
REQUIREMENT_LINE = r"^(\s*)([A-Za-z0-9._-]+)(\s*==\s*)([0-9][\w.]*)(.*)"
SAFE_VERSION = r">=\s*(\d+(?:\.\d+)*(?:[A-Za-z]\w*)?)"
SNIPPET_PACKAGE = r"^([A-Za-z0-9._-]+)=="


def _group(value: Column, pattern: str, group: int) -> Column:
    """A regex group, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(value, jvm_pattern(pattern), group), F.lit(""))


def parse_version(version: Column) -> Column:
    """Leading digits of every dot chunk as (size, digits), ``0`` where there are none.

    Without leading zeros, numbers of any length compare by how many digits they have, then by these.
    """

    def number(chunk):
        digits = F.ltrim(F.regexp_extract(chunk, r"^[0-9]+", 0), F.lit("0"))
        return _number(F.when(digits == "", "0").otherwise(digits))

    return F.transform(F.split(py_strip(version), r"\."), number)


def _number(digits: Column) -> Column:
    return F.struct(F.length(digits).alias("size"), digits.alias("digits"))


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two parsed versions; the shorter one is padded with zeros."""
    zero = _number(F.lit("0"))

    def padded(one: Column, other: Column) -> Column:
        return F.concat(one, F.array_repeat(zero, F.greatest(F.size(other) - F.size(one), F.lit(0))))

    def order(pair: Column) -> Column:
        pa, pb = padded(pair["a"], pair["b"]), padded(pair["b"], pair["a"])
        return F.when(pa < pb, -1).when(pa > pb, 1).otherwise(0)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), order))


def compare_version(a: Column, b: Column) -> Column:
    return compare_keys(parse_version(a), parse_version(b))


def specifier_op(specifier: Column) -> Column:
    return _group(specifier, SPECIFIER, 1)


def specifier_bound(specifier: Column) -> Column:
    return py_strip(_group(specifier, SPECIFIER, 2))


def satisfies(version_key: Column, op: Column, bound_key: Column) -> Column:
    """Does a parsed version fall under one comparator? False for an unknown one."""

    def holds(cmp: Column) -> Column:
        return (
            F.when(op == "<", cmp < 0)
            .when(op == "<=", cmp <= 0)
            .when(op == ">", cmp > 0)
            .when(op == ">=", cmp >= 0)
            .when(op == "==", cmp == 0)
        )

    return F.coalesce(let(compare_keys(version_key, bound_key), holds), F.lit(False))


def is_vulnerable(version: Column, specifier: Column) -> Column:
    return satisfies(
        parse_version(version), specifier_op(specifier), parse_version(specifier_bound(specifier))
    )


def clean_version(raw: Column) -> Column:
    """Concrete version of a manifest value; null for a wildcard or an open range."""
    bare = F.ltrim(F.ltrim(py_strip(raw), F.lit("^~")), F.lit("="))
    return F.nullif(F.regexp_extract(bare, r"^\d+(?:\.\d+)*", 0), F.lit(""))


def pinned_name(line: Column) -> Column:
    return _group(line, PINNED, 1)


def pinned_version(line: Column) -> Column:
    return _group(line, PINNED, 2)


def fixed_from_remediation(remediation: Column) -> Column:
    return _group(remediation, SAFE_VERSION, 1)


def package_from_snippet(snippet: Column) -> Column:
    return _group(snippet, SNIPPET_PACKAGE, 1)


def bump_requirement(line: Column, target: Column) -> Column:
    """The line pinned to ``target``; null where there is nothing to change."""
    jvm = jvm_pattern(REQUIREMENT_LINE)

    def part(n):
        return F.regexp_extract(line, jvm, n)

    new = F.concat(part(1), part(2), F.lit("=="), target, part(5))
    return F.when(F.rlike(line, F.lit(jvm)) & target.isNotNull() & (part(4) != target), new)


def requirement_name(line: Column) -> Column:
    return F.lower(_group(line, REQUIREMENT_LINE, 2))
