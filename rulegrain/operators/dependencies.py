"""Dependency manifests, and their join to advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths
from ..functions.once import let
from ..functions.text import NEWLINES, is_json, py_strip, strict_text
from ..functions.versions import (
    clean_version,
    parse_version,
    pinned_name,
    pinned_version,
    satisfies,
    specifier_bound,
    specifier_op,
)
from ..schema import SEVERITY_RANKS, as_findings, ordinal
from ..sources.corpus import of_kinds
from ..sources.tables import constant_table
from .ranges import join_ranges
from .lines import code_lines

# The offline advisories (ecosystem, package, id, vulnerable range, severity); the fix
# is the bound of the range. Summaries are our own words.
ADVISORIES = [
    ("pypi", "pyyaml", "CVE-2020-14343", "<5.4", "CRITICAL", "unsafe loaders can run code"),
    ("pypi", "requests", "CVE-2023-32681", "<2.31.0", "MEDIUM", "proxy credentials leak on a redirect"),
    ("pypi", "flask", "CVE-2023-30861", "<2.3.2", "HIGH", "a caching proxy may serve another user's session cookie"),
    ("pypi", "jinja2", "CVE-2024-22195", "<3.1.3", "MEDIUM", "the xmlattr filter allows cross-site scripting"),
    ("pypi", "django", "CVE-2023-43665", "<4.2.7", "HIGH", "truncating text can exhaust the server"),
    ("pypi", "cryptography", "CVE-2023-50782", "<42.0.0", "HIGH", "RSA decryption leaks timing"),
    ("npm", "lodash", "CVE-2021-23337", "<4.17.21", "HIGH", "templates can inject commands"),
    ("npm", "axios", "CVE-2023-45857", "<1.6.0", "MEDIUM", "redirects can leak credentials"),
    ("npm", "minimist", "CVE-2021-44906", "<1.2.6", "CRITICAL", "arguments can pollute object prototypes"),
]

SECTIONS = ["dependencies", "devDependencies"]


def advisory_table(spark: SparkSession) -> DataFrame:
    """The offline advisories: nine rows with their range already taken apart."""
    columns = dict.fromkeys(["ecosystem", "package", "id", "vulnerable", "severity", "summary"], "string")
    raw = constant_table(spark, columns, ADVISORIES)
    return with_ranges(raw.withColumn("fixed", specifier_bound(F.col("vulnerable"))))


def with_ranges(advisories: DataFrame) -> DataFrame:
    """Split each range into comparator and parsed bound, once per advisory."""
    return advisories.withColumn("op", specifier_op(F.col("vulnerable"))).withColumn(
        "bound_key", parse_version(specifier_bound(F.col("vulnerable")))
    )


def _manifests(corpus: DataFrame, name: str) -> DataFrame:
    return (
        of_kinds(corpus, "manifest")
        .where(F.lower(paths.basename(F.col("path"))) == name)
        .select("repo", "path", strict_text(F.col("content")).alias("text"))
        .where(F.col("text").isNotNull())
    )


def manifest_lines(corpus: DataFrame) -> DataFrame:
    """Lines of requirements files without comments, blanks and option lines."""
    return requirement_lines(corpus).where(~F.startswith(F.col("text"), F.lit("-")))


def requirement_lines(corpus: DataFrame) -> DataFrame:
    lines = code_lines(_manifests(corpus, "requirements.txt"), ends=NEWLINES)
    bare = lines.withColumn("text", py_strip(F.substring_index("text", "#", 1)))
    return bare.where(F.col("text") != "")


def requirements_deps(lines: DataFrame, ecosystem: str = "pypi") -> DataFrame:
    """Pinned ``name==version`` lines; every other form is dropped."""
    pinned = lines.select(
        "repo",
        "path",
        F.lit(ecosystem).alias("ecosystem"),
        pinned_name(F.col("text")).alias("name"),
        pinned_version(F.col("text")).alias("version"),
        "line",
        F.col("line").cast("bigint").alias("position"),
    )
    return pinned.where(F.col("name").isNotNull())


def _last_of_each(entries: Column) -> Column:
    """Of entries with one key the last, at the place of the first."""

    def folded(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, lambda e: e["key"]))
        last = lambda k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)
        return F.when(F.size(keys) == F.size(all_), all_).otherwise(F.transform(keys, last))

    return let(entries, folded)


def package_json_sections(corpus: DataFrame) -> DataFrame:
    """Raw entries of both dependency sections, in file order."""
    schema = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    documents = _manifests(corpus, "package.json").where(is_json(F.col("text")))
    parsed = documents.withColumn("doc", F.from_json("text", schema))

    def entries_of(section: str) -> Column:
        listed = F.coalesce(F.map_entries(F.col(f"doc.{section}")), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(
            _last_of_each(listed), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("raw"))
        )

    entries = F.concat(*[entries_of(s) for s in SECTIONS])
    rows = parsed.select("repo", "path", F.posexplode(entries).alias("position", "e"))
    return rows.select("repo", "path", F.col("position").cast("bigint").alias("position"), "e.section", "e.name", "e.raw")


def package_json_deps(corpus: DataFrame) -> DataFrame:
    """Entries of both sections with a concrete version; they carry no line."""
    deps = package_json_sections(corpus).select(
        "repo",
        "path",
        F.lit("npm").alias("ecosystem"),
        "name",
        clean_version(F.col("raw")).alias("version"),
        F.lit(0).alias("line"),
        "position",
    )
    return deps.where(F.col("version").isNotNull())


def offline_dependencies(corpus: DataFrame) -> DataFrame:
    """Dependencies the offline advisories are matched with."""
    return requirements_deps(manifest_lines(corpus)).unionByName(package_json_deps(corpus))


def extract_dependencies(corpus: DataFrame) -> DataFrame:
    """Dependencies for the feed: option lines stay in, ecosystems carry the feed's spelling."""
    return requirements_deps(requirement_lines(corpus), "PyPI").unionByName(package_json_deps(corpus))


def join_advisory(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Dependencies with every advisory whose range covers their version.

    The built-in table is nine rows and is broadcast. A table handed in may have hundreds of ranges per
    package: it goes through the interval index, which tests no range that does not cover the version.
    """
    keyed = deps.withColumn("package", F.lower("name"))
    if advisories is None:
        joined = keyed.withColumn("version_key", parse_version(F.col("version"))).join(F.broadcast(advisory_table(deps.sparkSession)), ["ecosystem", "package"])
        covered = joined.where(satisfies(F.col("version_key"), F.col("op"), F.col("bound_key")))
    else:
        covered = join_ranges(keyed, advisories, [F.col("repo"), F.col("path"), F.col("position")], ["id"])
    return covered.drop("version_key", "bound_key")


def dependency_findings(matches: DataFrame) -> DataFrame:
    name, version = F.col("name"), F.col("version")
    return as_findings(
        matches.select(
            "repo",
            F.col("id").alias("rule_id"),
            F.when(F.col("severity").isin(list(SEVERITY_RANKS)), F.col("severity")).otherwise("MEDIUM").alias("severity"),
            F.concat(name, F.lit(" "), version, F.lit(" falls under a published advisory. "), F.col("summary")).alias("message"),
            F.col("path").alias("file_path"),
            "line",
            F.concat(name, F.lit("=="), version).alias("snippet"),
            F.lit("dependency").alias("category"),
            F.lit(True).alias("fixable"),
            F.concat(F.lit("Upgrade "), name, F.lit(" to >= "), F.col("fixed"), F.lit(".")).alias("remediation"),
            ordinal("dependency", F.col("position")).alias("ordinal"),
        )
    )


def scan_dependencies(corpus: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    return dependency_findings(join_advisory(offline_dependencies(corpus), advisories))


def manifest_errors(corpus: DataFrame) -> DataFrame:
    """Manifests that cannot be read as what they claim to be: bad UTF-8, or JSON of another shape.

    Text that is no JSON at all is passed over without an error.
    """
    name = F.lower(paths.basename(F.col("path")))
    text = strict_text(F.col("content"))
    doc = F.try_parse_json(text)

    def kind(v: Column) -> Column:
        return F.substring_index(F.schema_of_variant(v), "<", 1)

    def no_object(section: str) -> Column:
        value = F.try_variant_get(doc, f"$.{section}", "variant")
        empty = F.to_json(value).isin("null", "false", "0", '""', "[]")
        return F.coalesce((kind(value) != "OBJECT") & ~empty, F.lit(False))

    shape = F.coalesce(kind(doc) != "OBJECT", F.lit(False)) | no_object(SECTIONS[0]) | no_object(SECTIONS[1])
    error = F.when(F.col("content").isNotNull() & text.isNull(), "dependency scan failed: not valid UTF-8").when(
        (name == "package.json") & is_json(text) & shape, "dependency scan failed: not a table of packages"
    )
    rows = of_kinds(corpus, "manifest").where(name.isin(paths.MANIFEST_NAMES)).select(
        "repo", F.col("path").alias("file_path"), error.alias("error")
    )
    return rows.where(F.col("error").isNotNull())
