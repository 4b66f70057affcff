"""Files to lines, and regex rules over lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.once import with_computed
from ..functions.text import (
    LINE_ENDS,
    contains_any,
    jvm_pattern,
    lenient_text,
    line_snippet,
    lines_of,
    matched_column,
    py_strip,
    strip_line_comment,
)
from ..schema import as_findings, ordinal
from ..sources.corpus import of_kinds
from .rules import LINE_RULES, LineRule, rule_table

LANG_EXT = {"js": paths.JS_EXT, "go": paths.GO_EXT, "java": paths.JAVA_EXT}


def code_lines(files: DataFrame, text: str = "text", ends: str = LINE_ENDS) -> DataFrame:
    """One row per line with its 1-based number; the other columns ride along."""
    keep = [F.col(c) for c in files.columns if c != text]
    split = files.select(*keep, F.posexplode(lines_of(F.col(text), ends)).alias("_pos", "text"))
    return split.select(*keep, (F.col("_pos") + 1).cast("int").alias("line"), "text")


def comment_strip(lines: DataFrame) -> DataFrame:
    """Lines without their ``//`` comment; lines left blank are dropped."""
    bare = lines.withColumn("text", strip_line_comment(F.col("text")))
    return bare.where(py_strip(F.col("text")) != "")


def rule_hits(text: Column, rules: list[LineRule]) -> Column:
    """Array with one (rule_id, column) per rule that matches the line.

    The literal test runs on the raw bytes; only a line that holds one of the rule's literals is
    decoded for the regex.
    """
    hits = []
    for rule in rules:
        matched = contains_any(text, rule.needles) & F.rlike(text, F.lit(jvm_pattern(rule.pattern)))
        hits.append(
            F.when(
                matched,
                F.struct(F.lit(rule.rule_id).alias("rule_id"), matched_column(text, rule.pattern).alias("column")),
            )
        )
    return F.array_compact(F.array(*hits))


def with_rule_columns(
    hits: DataFrame,
    scanner: str | Column,
    position: Column | None = None,
    order: Column | None = None,
    message: Column | None = None,
) -> DataFrame:
    """Add the constant columns of each rule; the rule table is a fixed few dozen rows."""
    position = F.col("line") if position is None else position
    order = F.col("rule_order") if order is None else order
    rules = F.broadcast(rule_table(hits.sparkSession))
    joined = hits.join(rules, "rule_id").withColumn("ordinal", ordinal(scanner, position, order))
    return as_findings(joined if message is None else joined.withColumn("message", message))


def _needles(rules: list[LineRule]) -> list[str]:
    return sorted({n for r in rules for n in r.needles})


def needles_of(lang: str) -> list[str]:
    return _needles([r for r in LINE_RULES if r.lang == lang])


def scan_lines(lines: DataFrame, rules: list[LineRule] = LINE_RULES) -> DataFrame:
    """Findings of the code rules on (repo, path, line, text), in one pass without a shuffle.

    The language follows from the path. Each matching rule gives one finding per line, at its first
    match after comments are cut.
    """
    ext = F.col("_ext")
    by_lang = {lang: [r for r in rules if r.lang == lang] for lang in LANG_EXT}
    by_lang = {lang: rs for lang, rs in by_lang.items() if rs}
    wanted = reduce(
        Column.__or__,
        [ext.isin(LANG_EXT[lang]) & contains_any(F.col("text"), _needles(rs)) for lang, rs in by_lang.items()],
    )
    named = with_computed(lines.select("repo", "path", "line", "text"), _ext=paths.extension(F.lower(paths.basename(F.col("path")))))
    bare = named.where(wanted).withColumn("text", strip_line_comment(F.col("text")))
    hits = None
    for lang, rs in by_lang.items():
        found = rule_hits(F.col("text"), rs)
        hits = F.when(ext.isin(LANG_EXT[lang]), found) if hits is None else hits.when(ext.isin(LANG_EXT[lang]), found)
    exploded = bare.select(
        "repo", F.col("path").alias("file_path"), "line", line_snippet(F.col("text")).alias("snippet"), F.inline(hits)
    )
    return with_rule_columns(exploded, "code")


def scan_code(corpus: DataFrame, rules: list[LineRule] = LINE_RULES) -> DataFrame:
    """The code rules over whole files (repo, path, content).

    Files of other languages, and files without any literal of their language's rules, are dropped
    before their text is split.
    """
    ext = paths.extension(F.lower(paths.basename(F.col("path"))))
    langs = {r.lang for r in rules}
    files = of_kinds(corpus, *langs).where(ext.isin(sorted(e for lang in langs for e in LANG_EXT[lang])))
    raw = F.col("content").cast("string")
    maybe = reduce(
        Column.__or__,
        [
            ext.isin(LANG_EXT[lang]) & contains_any(raw, _needles([r for r in rules if r.lang == lang]))
            for lang in sorted(langs)
        ],
    )
    texts = files.where(maybe).select("repo", "path", lenient_text(F.col("content")).alias("text"))
    return scan_lines(code_lines(texts), rules)


def unreadable_files(corpus: DataFrame) -> DataFrame:
    """LOW findings for files whose content is missing, or, for Python, no valid UTF-8."""
    name = F.lower(paths.basename(F.col("path")))
    ext = paths.extension(name)
    missing = F.col("content").isNull()
    bad = missing | ~F.is_valid_utf8(F.col("content").cast("string"))
    rule = (
        F.when(ext.isin(paths.PYTHON_EXT) & bad, "PY000")
        .when(ext.isin(paths.JS_EXT) & missing, "JS000")
        .when(ext.isin(paths.GO_EXT) & missing, "GO000")
        .when(ext.isin(paths.JAVA_EXT) & missing, "JAVA000")
    )
    rows = corpus.select(
        "repo",
        F.col("path").alias("file_path"),
        rule.alias("rule_id"),
        F.lit("LOW").alias("severity"),
        F.lit("The file could not be read.").alias("message"),
        ordinal("code", F.lit(0)).alias("ordinal"),
    )
    return as_findings(rows.where(F.col("rule_id").isNotNull()))
