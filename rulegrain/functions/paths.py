"""Path predicates, file dispatch and glob matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Directories no scan enters, and the shorter list of the project check.
SCAN_PRUNED = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env",
    ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode",
]
PROJECT_PRUNED = [".git", "node_modules", "__pycache__", ".venv", "venv"]

# Which files each scanner reads.
PYTHON_EXT = [".py", ".pyw"]
JS_EXT = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
GO_EXT = [".go"]
JAVA_EXT = [".java"]
MANIFEST_NAMES = ["requirements.txt", "package.json"]
SECRET_EXT = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".json", ".yml", ".yaml", ".env",
    ".ini", ".cfg", ".toml", ".txt", ".sh", ".rb", ".go", ".java", ".php",
    ".properties", ".xml", ".conf",
]
MAX_FILE_BYTES = 2_000_000

# Names of environment files with secrets, and endings of their templates.
ENV_NAMES = [".env", ".env.local", ".env.development", ".env.production", ".env.prod"]
ENV_TEMPLATES = [".example", ".sample", ".template", ".dist"]

_TOKEN = r"(?s)\[!?\]?[^\]]*\]|."
_WILDCARD = r"(?s)\[!?\]?[^\]]*\]|[*?]"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Last dot and what follows; leading dots open no extension."""
    return F.regexp_extract(name, r"(?s)[^.].*(\.[^.]*)$", 1)


def in_pruned_dir(path: Column, pruned: list[str] = SCAN_PRUNED) -> Column:
    dirs = F.split(F.regexp_replace(path, "[^/]*$", ""), "/")
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in pruned]))


def scanners_for(path: Column) -> Column:
    """Names of the scanners that read this file, in running order."""
    name = F.lower(basename(path))
    ext = extension(name)
    return F.array_compact(
        F.array(
            F.when(ext.isin(PYTHON_EXT), "python"),
            F.when(ext.isin(JS_EXT), "js"),
            F.when(ext.isin(GO_EXT), "go"),
            F.when(ext.isin(JAVA_EXT), "java"),
            F.when(name.isin(MANIFEST_NAMES), "dependency"),
            F.when(ext.isin(SECRET_EXT) | name.isin(MANIFEST_NAMES), "secret"),
        )
    )


def file_kind(path: Column) -> Column:
    """The group a file is stored under, so that a scanner reads only the groups it needs."""
    base = basename(path)
    name = F.lower(base)
    ext = extension(name)
    return (
        F.when(name.isin(MANIFEST_NAMES), "manifest")
        .when(base == ".gitignore", "gitignore")
        .when(ext.isin(PYTHON_EXT), "python")
        .when(ext.isin(JS_EXT), "js")
        .when(ext.isin(GO_EXT), "go")
        .when(ext.isin(JAVA_EXT), "java")
        .when(ext.isin(SECRET_EXT), "text")
        .otherwise("other")
    )


def is_secret_env_name(name: Column) -> Column:
    template = F.lit(False)
    for suffix in ENV_TEMPLATES:
        template = template | F.endswith(name, F.lit(suffix))
    return name.isin(ENV_NAMES) | (F.startswith(name, F.lit(".env")) & ~template)


def _char_class(token: Column) -> Column:
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    negated = F.startswith(inner, F.lit("!"))
    body = F.when(negated, F.substr(inner, F.lit(2))).otherwise(inner)
    pieces = F.regexp_extract_all(body, F.lit("(?s).-.|."), F.lit(0))
    valid = F.filter(
        pieces,
        lambda p: ~((F.length(p) == 3) & (F.substr(p, F.lit(1), F.lit(1)) > F.substr(p, F.lit(3), F.lit(1)))),
    )

    def spell(p):
        quoted = F.regexp_replace(p, r"([\[\]\\^&~|])", r"\\$1")
        return F.when(p == "-", r"\-").otherwise(quoted)

    text = F.array_join(F.transform(valid, spell), "")
    empty = F.size(valid) == 0
    return (
        F.when(empty & negated, "(?s:.)")
        .when(empty, "(?!)")
        .otherwise(F.concat(F.lit("["), F.when(negated, "^").otherwise(""), text, F.lit("]")))
    )


def glob_body(glob: Column) -> Column:
    """Shell glob as an unanchored Java regex; ``*`` crosses ``/``."""

    def spell(token):
        return (
            F.when(token == "*", ".*")
            .when(token == "?", ".")
            .when(F.length(token) > 1, _char_class(token))
            .when(F.rlike(token, F.lit(r"[\p{L}\p{N}_/ ]")), token)
            .otherwise(F.concat(F.lit("\\"), token))
        )

    return F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_TOKEN), F.lit(0)), spell), "")


def _one_star(glob: Column) -> Column:
    return F.regexp_replace(glob, r"\*+", "*")


def has_wildcard(glob: Column) -> Column:
    return F.rlike(glob, F.lit(_WILDCARD))


def suppression_regex(glob: Column) -> Column:
    """One regex for a path suppression: a directory (``x/``) or a glob on path, name or tail."""
    stem = F.rtrim(glob, F.lit("/"))
    quoted = F.regexp_replace(stem, r"([^\p{L}\p{N}_/ ])", r"\\$1")
    directory = F.concat(F.lit("(?s)^"), quoted, F.lit("$|^"), quoted, F.lit("/|/"), quoted, F.lit("/"))
    return F.when(F.endswith(glob, F.lit("/")), directory).otherwise(
        F.concat(F.lit(r"(?s)\A(?:.*/)?"), glob_body(_one_star(glob)), F.lit(r"\z"))
    )


def path_glob(path: Column, glob: Column) -> Column:
    """Does one suppression pattern cover the path?"""
    return F.rlike(path, suppression_regex(glob))


def gitignore_regex(pattern: Column) -> Column:
    """One regex for the four tests an ignore line gets: name, path, tail and path prefix."""
    pat = F.ltrim(pattern, F.lit("/"))
    return F.concat(
        F.lit(r"(?s)\A(?:(?:.*/)?"),
        glob_body(_one_star(pat)),
        F.lit(r"\z|"),
        glob_body(_one_star(F.rtrim(pat, F.lit("*")))),
        F.lit(")"),
    )


def gitignore_match(path: Column, pattern: Column) -> Column:
    return F.rlike(path, gitignore_regex(pattern))


def path_lineage(path: Column) -> Column:
    """The path, each of its parent directories and the root ``''``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
