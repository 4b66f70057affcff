"""Facts of Python syntax trees, and the rules over them.

Python code runs only to read a file's tree and list what it holds; every rule is a Catalyst
predicate on those rows.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.text import strict_text, universal_newlines
from ..sources.corpus import of_kinds
from ..sources.ship import ship_package
from ..sources.tables import stored
from .joins import lookup_join
from .lines import with_rule_columns
from .membership import may_be_in

FACT_SCHEMA = """repo string, path string, kind string, seq bigint, line int, `column` int, snippet string,
    name string, is_attribute boolean, attr string,
    keywords array<struct<arg: string, value: string, safe: boolean>>,
    n_args int, dynamic_sql boolean, arg1_safe boolean,
    nonempty_str boolean, has_star boolean, is_true boolean, message string"""

_KEYWORD = pa.struct([("arg", pa.string()), ("value", pa.string()), ("safe", pa.bool_())])
_ARROW = pa.schema(
    [
        ("repo", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("seq", pa.int64()),
        ("line", pa.int32()), ("column", pa.int32()), ("snippet", pa.string()),
        ("name", pa.string()), ("is_attribute", pa.bool_()), ("attr", pa.string()),
        ("keywords", pa.list_(_KEYWORD)),
        ("n_args", pa.int32()), ("dynamic_sql", pa.bool_()), ("arg1_safe", pa.bool_()),
        ("nonempty_str", pa.bool_()), ("has_star", pa.bool_()), ("is_true", pa.bool_()), ("message", pa.string()),
    ]
)

# The names, methods, keywords and constants the rules ask for.
DANGEROUS_CALLS = {
    "eval": "PY001", "exec": "PY002", "os.system": "PY003", "pickle.loads": "PY005", "pickle.load": "PY005",
}
YAML_LOADS = ["yaml.load", "load"]
WEAK_HASHES = ["hashlib.md5", "hashlib.sha1", "md5", "sha1"]
TEMP_NAMES = ["tempfile.mktemp", "mktemp"]
SQL_METHODS = ["execute", "executemany"]
FLAGS = ["shell", "verify", "debug", "autoescape"]
ANY_INTERFACE = "0.0.0.0"
SETTINGS = ["SECRET_KEY", "ALLOWED_HOSTS", "DEBUG"]

_WATCHED_CALLS = {*DANGEROUS_CALLS, *YAML_LOADS, *WEAK_HASHES, *TEMP_NAMES}
_WATCHED_METHODS = {*SQL_METHODS, "extractall"}


def _dotted(func: ast.expr) -> str:
    names = []
    while isinstance(func, ast.Attribute):
        names.insert(0, func.attr)
        func = func.value
    return ".".join([func.id, *names] if isinstance(func, ast.Name) else names)


def _names_safe(expr: ast.expr) -> bool:
    return "Safe" in ast.dump(expr)


def _builds_text(expr: ast.expr) -> bool:
    match expr:
        case ast.JoinedStr(values=parts):
            return any(isinstance(p, ast.FormattedValue) for p in parts)
        case ast.BinOp(op=ast.Add() | ast.Mod()) | ast.Call(func=ast.Attribute(attr="format")):
            return True
    return False


def _truth(expr: ast.expr) -> str | None:
    value = expr.value if isinstance(expr, ast.Constant) else None
    return str(value) if isinstance(value, bool) else None


def _call_fact(node: ast.Call, watched: bool) -> dict:
    is_attribute = isinstance(node.func, ast.Attribute)
    return {
        "kind": "call",
        "name": _dotted(node.func),
        "is_attribute": is_attribute,
        "attr": node.func.attr if is_attribute else None,
        "keywords": [
            {"arg": k.arg, "value": _truth(k.value), "safe": _names_safe(k.value) if not watched or k.arg == "Loader" else None}
            for k in node.keywords
        ],
        "n_args": len(node.args),
        "dynamic_sql": bool(node.args) and _builds_text(node.args[0]),
        "arg1_safe": _names_safe(node.args[1]) if len(node.args) > 1 else None,
    }


def _assign_facts(node: ast.Assign) -> Iterator[dict]:
    value = node.value
    elements = value.elts if isinstance(value, (ast.List, ast.Tuple)) else []
    constant = value.value if isinstance(value, ast.Constant) else None
    for target in node.targets:
        if isinstance(target, ast.Name):
            yield {
                "kind": "assign",
                "name": target.id,
                "nonempty_str": isinstance(constant, str) and constant.strip() != "",
                "has_star": any(isinstance(e, ast.Constant) and e.value == "*" for e in elements),
                "is_true": constant is True,
            }


def _facts(node: ast.AST, watched: bool) -> Iterator[dict]:
    """Facts of one node; ``watched`` keeps only those a rule can ask for."""
    if isinstance(node, ast.Call):
        fact = _call_fact(node, watched)
        if (
            not watched
            or fact["name"] in _WATCHED_CALLS
            or fact["attr"] in _WATCHED_METHODS
            or any(k["arg"] in FLAGS for k in fact["keywords"])
        ):
            yield fact
    elif isinstance(node, ast.Assign):
        yield from (f for f in _assign_facts(node) if not watched or f["name"] in SETTINGS)
    elif isinstance(node, ast.Constant) and isinstance(node.value, str):
        if not watched or node.value == ANY_INTERFACE:
            yield {"kind": "const", "name": _clean(node.value)}


def _clean(text: str) -> str:
    """Text without lone surrogates, which Arrow cannot carry."""
    return text.encode("utf-8", "replace").decode("utf-8")


def file_facts(source: str, watched: bool = True) -> list[dict]:
    """Facts of one file in the order of a walk from the top; one error row if that fails."""
    nowhere = {"seq": 0, "line": 0, "column": 0, "snippet": ""}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        return _walk(tree, source.splitlines(), watched)
    except SyntaxError as exc:
        return [nowhere | {"kind": "syntax", "line": exc.lineno or 0, "message": _clean(exc.msg)}]
    except (ValueError, RecursionError, MemoryError) as exc:
        return [nowhere | {"kind": "failed", "message": _clean(str(exc))}]


def _walk(tree: ast.AST, lines: list[str], watched: bool) -> list[dict]:
    found, pending = [], [tree]
    while pending:
        node = pending.pop()
        for fact in _facts(node, watched):
            in_file = 1 <= node.lineno <= len(lines)
            snippet = lines[node.lineno - 1].strip() if in_file else ""
            place = {"seq": len(found), "line": node.lineno, "column": node.col_offset + 1, "snippet": snippet}
            found.append(fact | place)
        pending.extend(reversed(list(ast.iter_child_nodes(node))))
    return found


def py_facts(sources: DataFrame, watched: bool = True) -> DataFrame:
    """Facts of Python files (repo, path, text); no shuffle, one file in memory at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*(batch.column(c) for c in ("repo", "path", "text"))):
                head = {"repo": repo.as_py(), "path": path.as_py()}
                rows.extend(head | fact for fact in file_facts(text.as_py(), watched))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    ship_package(sources.sparkSession)
    return sources.select("repo", "path", "text").mapInArrow(read, FACT_SCHEMA)


def facts_by_content(sources: DataFrame, watched: bool = True) -> DataFrame:
    """The rows of py_facts, with each distinct text parsed once, however many places hold it.

    For corpora with many vendored copies. Texts are digested where they are read, and one place stands
    for all of a digest; a filter picks these places' texts, so no text is shuffled. (repo, path) has to
    be unique.
    """
    places = stored(sources.select("repo", "path", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")))
    first = places.groupBy("digest").agg(F.min(F.struct("repo", "path")).alias("first"))
    standing = stored(first.select("digest", "first.repo", "first.path"))
    facts = stored(py_facts(may_be_in(sources, standing, ["repo", "path"]), watched))
    columns = facts.columns
    # the filter lets a few other places through, whose facts are dropped here
    of_digest = facts.join(standing, ["repo", "path"]).drop("repo", "path")
    spread = [F.col("repo"), F.col("path")]
    return lookup_join(places, of_digest, ["digest"], "inner", spread).select(*[F.col(f"`{c}`") for c in columns])


def python_sources(corpus: DataFrame) -> DataFrame:
    """Readable Python files as text."""
    ext = paths.extension(F.lower(paths.basename(F.col("path"))))
    text = universal_newlines(strict_text(F.col("content")))
    return of_kinds(corpus, "python").where(ext.isin(paths.PYTHON_EXT)).select("repo", "path", text.alias("text")).where("text is not null")


def _flag(name: str, value: str) -> Column:
    return F.exists(F.col("keywords"), lambda k: (k["arg"] == name) & (k["value"] == value))


def _unsafe_yaml() -> Column:
    loader = F.get(F.filter(F.col("keywords"), lambda k: k["arg"] == "Loader"), F.lit(0))
    named = (F.col("name") == "yaml.load") | ((F.col("name") == "load") & F.col("is_attribute"))
    unsafe = (
        F.when(loader.isNotNull(), ~loader["safe"])
        .when(F.col("n_args") >= 2, ~F.col("arg1_safe"))
        .otherwise(F.col("name") == "yaml.load")
    )
    return named & unsafe


def rule_conditions() -> dict[str, Column]:
    """Rule id to predicate on a fact row, in the order findings of one node are listed."""
    name, call = F.col("name"), F.col("kind") == "call"
    rules = {"PY000": F.col("kind") == "syntax"}
    for rule in sorted(set(DANGEROUS_CALLS.values())):
        rules[rule] = call & name.isin([n for n, r in DANGEROUS_CALLS.items() if r == rule])
    assign = F.col("kind") == "assign"
    return rules | {
        "PY004": call & F.startswith(name, F.lit("subprocess.")) & _flag("shell", "True"),
        "PY006": call & _unsafe_yaml(),
        "PY007": call & name.isin(WEAK_HASHES),
        "PY009": call & _flag("verify", "False"),
        "PY010": call & F.endswith(name, F.lit("run")) & _flag("debug", "True"),
        "PY011": call & (F.col("attr") == "extractall"),
        "PY012": call & name.isin(TEMP_NAMES),
        "PY013": call & _flag("autoescape", "False"),
        "PY008": call & F.col("attr").isin(SQL_METHODS) & F.col("dynamic_sql"),
        "DJ001": assign & (name == "SECRET_KEY") & F.col("nonempty_str"),
        "DJ002": assign & (name == "ALLOWED_HOSTS") & F.col("has_star"),
        "DJ003": assign & (name == "DEBUG") & F.col("is_true"),
        "PY014": (F.col("kind") == "const") & (name == ANY_INTERFACE),
    }


def python_findings(facts: DataFrame) -> DataFrame:
    """Findings PY000-PY014 and DJ001-DJ003 from facts."""
    hits = [
        F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(i).alias("_order")))
        for i, (rule, cond) in enumerate(rule_conditions().items())
    ]
    place = ["repo", F.col("path").alias("file_path"), "line", "column", "snippet", "name", "seq"]
    found = facts.select(*place, F.inline(F.array_compact(F.array(*hits))))
    named = F.when(F.col("rule_id").isin("PY004", "PY007"), F.concat(F.col("name"), F.lit(": "), F.col("message")))
    return with_rule_columns(found, "code", F.col("seq"), F.col("_order"), F.coalesce(named, F.col("message")))


def python_errors(facts: DataFrame) -> DataFrame:
    """Files the parser gave up on for another reason than their syntax."""
    return facts.where(F.col("kind") == "failed").select(
        "repo", F.col("path").alias("file_path"), F.concat(F.lit("python scan failed: "), F.col("message")).alias("error")
    )


def scan_python(corpus: DataFrame) -> DataFrame:
    return python_findings(py_facts(python_sources(corpus)))
