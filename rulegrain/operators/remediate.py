"""Line fixes, version bumps and patched files, worked out inside each file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.once import let, with_computed
from ..functions.text import (
    contains_any,
    env_name,
    jvm_pattern,
    lines_of,
    py_strip,
    strict_text,
    universal_newlines,
)
from ..functions.versions import bump_requirement, fixed_from_remediation, package_from_snippet, requirement_name
from ..sources.tables import stored
from .membership import may_be_in, only_members
from .rules import SECRET_NAMES, SECRET_NEEDLES, SECRET_VALUE

# What each fix looks for and writes instead.
REPLACEMENTS = {
    "PY009": (r"verify\s*=\s*False", "verify=True"),
    "PY010": (r"debug\s*=\s*True", "debug=False"),
    "PY013": (r"autoescape\s*=\s*False", "autoescape=True"),
    "GO004": (r"InsecureSkipVerify\s*:\s*true", "InsecureSkipVerify: false"),
}
ASSIGNMENT = rf"(?i)\A(\s*(\w*(?:{SECRET_NAMES})\w*)\s*[:=]\s*){SECRET_VALUE}\3(.*)\z"
FIXABLE_RULES = ["PY006", *REPLACEMENTS, "SEC006"]

# A file without any of these holds no line a fixer would change.
FIX_NEEDLES = ["yaml.load(", "verify", "debug", "autoescape", "InsecureSkipVerify"]

CONTEXT = 3

_NO_ENV = "array<struct<name:string,value:string>>"

_ASSIGNED = jvm_pattern(ASSIGNMENT)
# Only \n ends a line for ^ here, as in Python.
_BY_LINE = "(?dm)"


def fix_yaml_load(line: Column) -> Column:
    can = F.contains(line, F.lit("yaml.load(")) & ~F.contains(line, F.lit("Loader"))
    return F.when(can, F.replace(line, F.lit("yaml.load("), F.lit("yaml.safe_load(")))


def _replace(rule: str, line: Column) -> Column:
    pattern, text = REPLACEMENTS[rule]
    return F.when(F.rlike(line, F.lit(jvm_pattern(pattern))), F.regexp_replace(line, jvm_pattern(pattern), text))


def fix_verify_false(line: Column) -> Column:
    return _replace("PY009", line)


def fix_debug_true(line: Column) -> Column:
    return _replace("PY010", line)


def fix_autoescape_false(line: Column) -> Column:
    return _replace("PY013", line)


def fix_insecure_skip_verify(line: Column) -> Column:
    return _replace("GO004", line)


def secret_variable(line: Column) -> Column:
    return env_name(F.regexp_extract(line, _ASSIGNED, 2))


def secret_value(line: Column) -> Column:
    return F.regexp_extract(line, _ASSIGNED, 4)


def fix_hardcoded_secret(line: Column) -> Column:
    """The line reading its value from the environment; null where it is no assignment."""
    new = F.concat(
        F.regexp_extract(line, _ASSIGNED, 1),
        F.lit('os.environ["'),
        secret_variable(line),
        F.lit('"]'),
        F.regexp_extract(line, _ASSIGNED, 5),
    )
    return F.when(F.rlike(line, F.lit(_ASSIGNED)), new)


FIXERS = {
    "PY006": fix_yaml_load,
    "PY009": fix_verify_false,
    "PY010": fix_debug_true,
    "PY013": fix_autoescape_false,
    "GO004": fix_insecure_skip_verify,
    "SEC006": fix_hardcoded_secret,
}


def fix_line(rule_id: Column, line: Column) -> Column:
    """The line after one rule's fix; null where it changes nothing."""
    out = F.when(F.lit(False), F.lit(""))
    for rule, fixer in FIXERS.items():
        out = out.when(rule_id == rule, fixer(line))
    return out


def fixable_filter(findings: DataFrame) -> DataFrame:
    """Findings a line fixer exists for."""
    return findings.where(F.col("fixable") & F.col("rule_id").isin(FIXABLE_RULES) & (F.col("line") > 0))


def fold_line(line: Column, rules: Column) -> Column:
    """Apply the fixes of a line one after the other: its text, how many took, and the variables found."""
    start = F.struct(
        line.alias("text"),
        F.lit(0).alias("changes"),
        F.array().cast(_NO_ENV).alias("env"),
    )

    def step(state: Column, rule: Column) -> Column:
        text, env = state["text"], state["env"]
        found = F.array(F.struct(secret_variable(text).alias("name"), secret_value(text).alias("value")))
        changed = lambda new: F.struct(
            new.alias("text"),
            (state["changes"] + 1).alias("changes"),
            F.when(rule == "SEC006", F.concat(env, found)).otherwise(env).alias("env"),
        )
        return let(fix_line(rule, text), lambda new: F.when(new.isNull(), state).otherwise(changed(new)))

    return F.aggregate(rules, start, step)


def line_fixes(findings: DataFrame) -> DataFrame:
    """Rules to apply per line, in finding order; copies of a finding are folded on the map side.

    A line's list is bounded by the line's own length.
    """
    grouped = fixable_filter(findings).groupBy("repo", F.col("file_path").alias("path"), "line")
    rules = F.transform(F.sort_array(F.collect_set(F.struct("ordinal", "rule_id"))), lambda s: s["rule_id"])
    return grouped.agg(rules.alias("rules"))


def join_fixers(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Fixable findings beside the source line they stand on and the line each fix alone would give.

    Lines without such a finding are left out where they are read, before the join.
    """
    fixes = stored(fixable_filter(findings).select(
        "repo", F.col("file_path").alias("path"), "line", "rule_id", "ordinal", "column"
    ))
    there = may_be_in(lines.select("repo", "path", "line", "text"), fixes, ["repo", "path", "line"])
    joined = fixes.join(there, ["repo", "path", "line"])
    return joined.withColumn("new_text", fix_line(F.col("rule_id"), F.col("text")))


def line_fold(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines after all their fixes; lines without one are left out where they are read."""
    fixes = stored(line_fixes(findings))
    there = may_be_in(lines.select("repo", "path", "line", "text"), fixes, ["repo", "path", "line"])
    joined = there.join(fixes, ["repo", "path", "line"])
    folded = joined.withColumn("f", fold_line(F.col("text"), F.col("rules")))
    return folded.select(
        "repo", "path", "line", "text", F.col("f.text").alias("new_text"), F.col("f.changes").alias("changes"), F.col("f.env").alias("env")
    )


def dep_targets(findings: DataFrame) -> DataFrame:
    """Version to pin each package to, per file: that of the last finding."""
    package = F.lower(package_from_snippet(F.col("snippet")))
    fixed = fixed_from_remediation(F.col("remediation"))
    rows = findings.where((F.col("category") == "dependency") & F.col("fixable")).select(
        "repo", F.col("file_path").alias("path"), package.alias("package"), fixed.alias("target"), "ordinal"
    )
    named = rows.where(F.col("package").isNotNull() & F.col("target").isNotNull())
    return named.groupBy("repo", "path", "package").agg(F.max_by("target", F.struct("ordinal", "target")).alias("target"))


def join_dep_targets(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Requirement lines (repo, path, line, text) with their new text where the pin moves."""
    keyed = lines.withColumn("package", requirement_name(F.col("text")))
    joined = keyed.join(targets, ["repo", "path", "package"])
    bumped = joined.withColumn("new_text", bump_requirement(F.col("text"), F.col("target")))
    return bumped.where(F.col("new_text").isNotNull()).select("repo", "path", "line", "text", "new_text")


def needs_os_import(text: Column) -> Column:
    """Does a patched file use os.environ without importing os?"""
    imported = F.rlike(text, F.lit(_BY_LINE + jvm_pattern(r"^\s*import os\b"))) | F.rlike(
        text, F.lit(_BY_LINE + jvm_pattern(r"^\s*import\s+os\s*,"))
    )
    return F.contains(text, F.lit("os.environ")) & ~imported


def import_position(lines: Column) -> Column:
    """0-based place of the new import: before the first code line, else after a shebang."""
    code = F.transform(lines, lambda l: (py_strip(l) != "") & ~F.startswith(py_strip(l), F.lit("#")))
    shebang = F.startswith(py_strip(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), F.lit("#!"))
    without_code = F.when(shebang, 1).otherwise(0)
    return let(F.array_position(code, True), lambda at: F.when(at > 0, at - 1).otherwise(without_code)).cast("int")


def ensure_os_import(files: DataFrame) -> DataFrame:
    """Files (text) with ``import os`` added where it is missing, and where it went."""
    lines = lines_of(F.col("text"))
    placed = with_computed(files, import_at=F.when(needs_os_import(F.col("text")), import_position(lines)))
    grown = joined_lines(F.array_insert(lines, F.col("import_at") + 1, F.lit("import os")), F.col("text"))
    return placed.withColumn("text", F.when(F.col("import_at").isNull(), F.col("text")).otherwise(grown))


def joined_lines(lines: Column, original: Column) -> Column:
    """Lines joined by ``\\n``; a final newline stays if there was one."""
    return F.concat(F.array_join(lines, "\n"), F.when(F.endswith(original, F.lit("\n")), "\n").otherwise(""))


def reassemble_file(lines: DataFrame) -> DataFrame:
    """Files from their lines.

    Files are at most the size cap, and copies of a line are folded on the map side, so a file's
    lines fit in one task.
    """
    grouped = lines.groupBy("repo", "path").agg(F.sort_array(F.collect_set(F.struct("line", "text"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda s: s["text"]), "\n")
    return grouped.select("repo", "path", text.alias("text"), F.size("lines").cast("bigint").alias("n_lines"))


def _may_change(text: Column) -> Column:
    return contains_any(text, FIX_NEEDLES) | let(F.lower(text), lambda low: contains_any(low, SECRET_NEEDLES))


def _is_requirements() -> Column:
    return F.lower(paths.basename(F.col("path"))) == "requirements.txt"


def fix_plan(findings: DataFrame, python_secrets_only: bool = True) -> DataFrame:
    """Per file the (line, rules) to fix and the (package, target) to pin, as arrays.

    Both lists are bounded by the file they belong to, which is at most the size cap.
    Secrets are moved to os.environ in Python files only, unless asked otherwise.
    """
    name = F.lower(paths.basename(F.col("path")))
    lines = line_fixes(
        findings
        if not python_secrets_only
        else findings.where(
            (F.col("rule_id") != "SEC006")
            | paths.extension(F.lower(paths.basename(F.col("file_path")))).isin(paths.PYTHON_EXT)
        )
    ).where(name != "requirements.txt")
    by_line = lines.groupBy("repo", "path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("line", "rules")))).alias("fixes")
    )
    pins = dep_targets(findings).where(name == "requirements.txt").groupBy("repo", "path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("package", "target")))).alias("pins")
    )
    none = F.lit(None)
    return by_line.withColumn("pins", none.cast("map<string,string>")).unionByName(
        pins.withColumn("fixes", none.cast("map<int,array<string>>"))
    )


def fix_candidate_files(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with at least one fixable finding; the contents of others are not shuffled."""
    fixable = stored(findings.where("fixable").select("repo", F.col("file_path").alias("path")).distinct())
    return only_members(corpus, fixable, ["repo", "path"])


def _line_state(text: Column, changes: Column) -> Column:
    return F.struct(text.alias("text"), changes.alias("changes"), F.array().cast(_NO_ENV).alias("env"))


def fixed_lines(corpus: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned files with their lines before and after the fixes.

    Files without a planned fix, and those that hold no fixer's literal, are dropped where they are
    read, so their contents are not shuffled; everything after the join happens inside the file's own row.
    """
    text = universal_newlines(strict_text(F.col("content")))
    plan = stored(plan)
    planned_files = may_be_in(corpus, plan, ["repo", "path"])
    files = planned_files.where(_is_requirements() | _may_change(F.col("content").cast("string"))).select(
        "repo", "path", text.alias("original")
    )
    joined = files.where(F.col("original").isNotNull()).join(plan, ["repo", "path"])

    def folded(line: Column, i: Column) -> Column:
        planned = F.try_element_at(F.col("fixes"), (i + 1).cast("int"))
        return let(
            planned,
            lambda rules: F.when(rules.isNull(), _line_state(line, F.lit(0))).otherwise(fold_line(line, rules)),
        )

    def pinned(line: Column) -> Column:
        target = F.try_element_at(F.col("pins"), requirement_name(line))
        return let(
            bump_requirement(line, target),
            lambda new: F.when(new.isNull(), _line_state(line, F.lit(0))).otherwise(_line_state(new, F.lit(1))),
        )

    split = with_computed(joined, lines=lines_of(F.col("original")))
    after = F.when(F.col("pins").isNotNull(), F.transform("lines", pinned)).otherwise(F.transform("lines", folded))
    return with_computed(split, folded=after).select("repo", "path", "original", "lines", "folded")


def patched_files(corpus: DataFrame, findings: DataFrame, python_secrets_only: bool = True) -> DataFrame:
    """Changed files: original, fixed text, number of changes, place of a new import, variables.

    The input is never written to; the original stays beside the fixed text. Secrets are moved to
    os.environ in Python files only, unless asked otherwise.
    """
    files = with_computed(
        fixed_lines(corpus, fix_plan(findings, python_secrets_only)),
        text=joined_lines(F.transform("folded", lambda f: f["text"]), F.col("original")),
        env=F.flatten(F.transform("folded", lambda f: f["env"])),
        n=F.aggregate("folded", F.lit(0), lambda n, f: n + f["changes"]),
    ).where("n > 0")
    at = F.when((F.size("env") > 0) & needs_os_import(F.col("text")), import_position(lines_of(F.col("text"))))
    placed = with_computed(files.select("repo", "path", "original", "text", "env", "n"), import_at=at)
    grown = joined_lines(
        F.array_insert(lines_of(F.col("text")), F.col("import_at") + 1, F.lit("import os")), F.col("text")
    )
    out = with_computed(
        placed,
        fixed=F.when(F.col("import_at").isNull(), F.col("text")).otherwise(grown),
        change_count=F.col("n") + F.when(F.col("import_at").isNull(), 0).otherwise(1),
    )
    changed = out.where(F.col("fixed") != F.col("original"))
    return changed.select("repo", "path", "original", "fixed", "change_count", "import_at", "env")


def changed_files(patched: DataFrame) -> DataFrame:
    return patched.select("repo", "path", "change_count")


def sorted_fixes(patched: DataFrame) -> DataFrame:
    return changed_files(patched).orderBy("path", "repo")


def change_totals(patched: DataFrame) -> DataFrame:
    return patched.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("change_count"), F.lit(0)).cast("bigint").alias("changes")
    )


def diff_hunks(patched: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Hunks of the unified diff: line ranges before and after, and how many lines changed.

    Old and new lines are aligned by number, shifted by one after an inserted import. Changes closer
    than twice the context share a hunk.
    """
    at = F.col("import_at")
    split = with_computed(
        patched.select("repo", "path", "import_at", "original", "fixed"),
        old=lines_of(F.col("original")),
        new=lines_of(F.col("fixed")),
    )

    def edit(line: Column, i: Column) -> Column:
        shift = F.when(at.isNotNull() & (i >= at), 1).otherwise(0)
        same = F.get(F.col("new"), i + shift) == line
        return F.when(~same, F.struct(i.alias("start"), (i + 1).alias("stop")))

    replaced = F.array_compact(F.transform("old", edit))
    insertion = F.struct(at.alias("start"), at.alias("stop"))
    edits = F.when(at.isNull(), replaced).otherwise(F.sort_array(F.concat(F.array(insertion), replaced)))
    listed = with_computed(split.select("repo", "path", "import_at", F.size("old").alias("n"), "old", "new"), edits=edits)

    def opens(e: Column, i: Column) -> Column:
        return (i == 0) | (e["start"] - F.get(F.col("edits"), i - 1)["stop"] > 2 * context)

    opened = with_computed(listed.select("repo", "path", "import_at", "n", "edits"), firsts=F.filter("edits", opens))
    rows = opened.select("*", F.posexplode("firsts").alias("hunk", "first"))
    following = F.get(F.col("firsts"), F.col("hunk") + 1)["start"]
    mine = F.filter(
        "edits",
        lambda e: (e["start"] >= F.col("first.start"))
        & (e["stop"] >= F.col("first.stop"))
        & (F.col("following").isNull() | (e["start"] < F.col("following"))),
    )
    ranged = with_computed(rows.withColumn("following", following), mine=mine)
    low = F.greatest(F.col("first.start") - context, F.lit(0))
    high = F.least(F.element_at("mine", -1)["stop"] + context, F.col("n"))
    before = F.when(at.isNotNull() & (F.col("first.start") > at), 1).otherwise(0)
    within = F.when(F.exists("mine", lambda e: e["start"] == e["stop"]), 1).otherwise(0)
    return ranged.select(
        "repo",
        "path",
        (F.col("hunk") + 1).cast("int").alias("hunk"),
        (low + 1).cast("int").alias("old_start"),
        (high - low).cast("int").alias("old_lines"),
        (low + before + 1).cast("int").alias("new_start"),
        (high - low + within).cast("int").alias("new_lines"),
        F.size("mine").cast("int").alias("changes"),
    )


def env_vars(patched: DataFrame, scope: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Variables found, with the last value in file order and their rank of first sight."""
    rows = patched.select("repo", "path", F.posexplode("env").alias("no", "v")).select(
        "repo", "path", F.col("no").cast("int").alias("no"), F.col("v.name").alias("name"), F.col("v.value").alias("value")
    )
    return rows.groupBy(*scope, "name").agg(
        F.max_by("value", F.struct("path", "no")).alias("value"), F.min(F.struct("path", "no")).alias("first_seen")
    )


def env_example(variables: DataFrame, corpus: DataFrame) -> DataFrame:
    """Placeholder lines for variables the repository's .env.example does not mention; never values.

    A variable counts as present when the file holds its name followed by ``=`` anywhere, so the file
    lists every ending of the names it assigns and the test becomes an anti join.
    """
    text = F.coalesce(strict_text(F.col("content")), F.lit(""))
    names = corpus.where(F.col("path") == ".env.example").select(
        "repo", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z0-9_]+)="), F.lit(1)))).alias("run")
    )
    endings = F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.substr(F.col("run"), i))
    present = names.select("repo", F.explode(endings).alias("name")).distinct()
    missing = variables.join(present, ["repo", "name"], "left_anti")
    return missing.select("repo", "name", F.concat("name", F.lit("=CHANGE_ME")).alias("entry"))
