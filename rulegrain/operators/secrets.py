"""Secrets: fixed token shapes, and assigned values with high entropy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.once import let, with_computed
from ..functions.text import contains_any, jvm_pattern, lenient_text, line_snippet, shannon_entropy, strip_line_comment
from ..schema import SCANNER_ORDER
from ..sources.corpus import of_kinds
from .lines import LANG_EXT, code_lines, needles_of, rule_hits, with_rule_columns
from .rules import (
    LINE_RULES,
    MIN_ENTROPY,
    PLACEHOLDER,
    SECRET_NAMES,
    SECRET_NEEDLES,
    SECRET_RULES,
    SECRET_VALUE,
)

SECRET_KINDS = ["python", "js", "go", "java", "manifest", "text"]

# The name is searched from its keyword on, not from the word's start: that keeps a search linear on
# long words. The word's start is recovered from the text before the match.
_ASSIGNED = jvm_pattern(rf"(?i)(?:{SECRET_NAMES})\w*\s*[:=]\s*{SECRET_VALUE}\1")
# The same from the end of the match before on: what stands between, the assignment, its quote and its value.
_NEXT_ASSIGNED = jvm_pattern(rf"(?i)\G((?s:.*?))((?:{SECRET_NAMES})\w*\s*[:=]\s*{SECRET_VALUE}\3)")


def assigned_value(line: Column) -> Column:
    """Value of the first credential-like assignment in the line, '' without one."""
    return F.regexp_extract(line, _ASSIGNED, 2)


def is_secret_value(value: Column) -> Column:
    return (
        (F.length(value) >= 6)
        & (shannon_entropy(value) >= MIN_ENTROPY)
        & ~F.rlike(value, F.lit(PLACEHOLDER))
    )


def _assigned_start(line: Column) -> Column:
    """Characters before the first assignment whose value counts as a secret; null without one.

    Each is read with what stands before it, which says where it begins; ``split`` would compile the pattern
    anew for each line.
    """
    gaps, bodies, values = (F.regexp_extract_all(line, F.lit(_NEXT_ASSIGNED), F.lit(i)) for i in (1, 2, 4))
    sizes = F.zip_with(gaps, bodies, lambda gap, body: F.struct(F.length(gap).alias("gap"), F.length(body).alias("size")))
    places = F.zip_with(sizes, values, lambda s, value: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), is_secret_value(value).alias("counts")))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, place: Column) -> Column:
        here = state["at"] + place["gap"]
        return F.struct(
            (here + place["size"]).alias("at"), F.coalesce(state["found"], F.when(place["counts"], here)).alias("found")
        )

    return F.aggregate(places, start, step)["found"]


def _assigned_column(line: Column, start: Column) -> Column:
    word = F.regexp_extract(F.reverse(F.substr(line, F.lit(1), start)), jvm_pattern(r"\A\w*"), 0)
    return (start - F.length(word) + 1).cast("int")


def _may_assign(text: Column) -> Column:
    quoted = F.contains(text, F.lit("'")) | F.contains(text, F.lit('"'))
    return quoted & let(F.lower(text), lambda low: contains_any(low, SECRET_NEEDLES))


def _secret_hits(text: Column) -> Column:
    # The cheap tests stand first in each condition: the regex runs on few lines, the entropy on fewer.
    assigned = F.when(_may_assign(text) & F.rlike(text, F.lit(_ASSIGNED)), _assigned_start(text))
    generic = let(
        assigned,
        lambda start: F.when(
            start.isNotNull(), F.struct(F.lit("SEC006").alias("rule_id"), _assigned_column(text, start).alias("column"))
        ),
    )
    return F.concat(rule_hits(text, SECRET_RULES), F.array_compact(F.array(generic)))


def scan_secret_lines(lines: DataFrame) -> DataFrame:
    """Findings SEC001-SEC008 on (repo, path, line, text), without a shuffle."""
    text = F.col("text")
    shapes = [n for r in SECRET_RULES for n in r.needles]
    found = lines.where(contains_any(text, shapes) | _may_assign(text)).select(
        "repo", F.col("path").alias("file_path"), "line", line_snippet(text).alias("snippet"), F.inline(_secret_hits(text))
    )
    return with_rule_columns(found, "secret")


def scan_secrets(corpus: DataFrame) -> DataFrame:
    """The secret rules over whole files of the text kinds."""
    raw = F.col("content").cast("string")
    shapes = [n for r in SECRET_RULES for n in r.needles]
    files = of_kinds(corpus, *SECRET_KINDS).where(F.array_contains(paths.scanners_for(F.col("path")), "secret"))
    texts = files.where(contains_any(raw, shapes) | _may_assign(raw)).select(
        "repo", "path", lenient_text(F.col("content")).alias("text")
    )
    return scan_secret_lines(code_lines(texts))


def scan_text(corpus: DataFrame) -> DataFrame:
    """Code and secret rules over whole files in one read of the corpus.

    Code rules see a line without its comment and only in files of their language; secret rules see
    the whole line in files of the text kinds. A file is split only if it holds some rule's literal.
    """
    base = F.lower(paths.basename(F.col("path")))
    raw = F.col("content").cast("string")
    shapes = [n for r in SECRET_RULES for n in r.needles]
    named = with_computed(of_kinds(corpus, *SECRET_KINDS, *LANG_EXT).select("repo", "path", "content"), _name=base, _ext=paths.extension(base))
    ext = F.col("_ext")
    looks = {lang: ext.isin(exts) & contains_any(raw, needles_of(lang)) for lang, exts in LANG_EXT.items()}
    secret = ext.isin(paths.SECRET_EXT) | F.col("_name").isin(paths.MANIFEST_NAMES)
    looks["secret"] = secret & (contains_any(raw, shapes) | _may_assign(raw))
    # one flag for each group of rules, known before the text is split
    flagged = with_computed(named, **{f"_{look}": F.coalesce(c, F.lit(False)) for look, c in looks.items()})
    texts = flagged.where(reduce(Column.__or__, [F.col(f"_{look}") for look in looks])).select(
        "repo", "path", *[f"_{look}" for look in looks], lenient_text(F.col("content")).alias("text")
    )
    text, bare = F.col("text"), F.col("bare")
    held = {lang: contains_any(text, needles_of(lang)) for lang in LANG_EXT} | {"secret": contains_any(text, shapes) | _may_assign(text)}
    lines = code_lines(texts).where(reduce(Column.__or__, [F.col(f"_{look}") & c for look, c in held.items()]))
    lines = lines.withColumn("bare", strip_line_comment(text))
    none = F.array().cast("array<struct<rule_id:string,column:int>>")
    hits = {lang: rule_hits(bare, [r for r in LINE_RULES if r.lang == lang]) for lang in LANG_EXT} | {"secret": _secret_hits(text)}
    arrays = [F.when(F.col(f"_{look}"), found).otherwise(none) for look, found in hits.items()]
    found = lines.select("repo", F.col("path").alias("file_path"), "line", "text", "bare", F.inline(F.concat(*arrays)))
    secret_rule = F.startswith("rule_id", F.lit("SEC"))
    named = found.withColumn("snippet", line_snippet(F.when(secret_rule, text).otherwise(bare)))
    order = F.when(secret_rule, SCANNER_ORDER["secret"]).otherwise(SCANNER_ORDER["code"])
    return with_rule_columns(named, order)
