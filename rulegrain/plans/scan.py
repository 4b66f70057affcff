"""The whole scan, and the fixes of one.

Results that several steps read are written on the way, so building a scan runs jobs; for streams use
``streaming``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..functions.paths import MAX_FILE_BYTES
from ..operators import roots as rt
from ..operators.dependencies import extract_dependencies, manifest_errors, scan_dependencies
from ..operators.findings import DEDUPE_KEYS, dedupe_findings, suppress, suppress_with_tables, suppression_tables, union_scanners
from ..operators.lines import unreadable_files
from ..operators.membership import only_members
from ..operators.osv import scan_osv
from ..operators.project import scan_project
from ..operators.pyfacts import py_facts, python_errors, python_findings, python_sources
from ..operators.remediate import patched_files
from ..operators.secrets import scan_text
from ..sources.corpus import corpus_inventory, oversized_files, scannable, scanned_files, too_large
from ..sources.tables import stored


@dataclass(frozen=True)
class Scan:
    """The three tables a scan gives."""

    findings: DataFrame
    stats: DataFrame
    errors: DataFrame

    def kept(self) -> Scan:
        """The same tables written once, for use by several reports or by the fixes."""
        return Scan(stored(self.findings), stored(self.stats), stored(self.errors))


def scan(
    corpus: DataFrame,
    tracked: DataFrame,
    advisories: DataFrame | None = None,
    replies: DataFrame | None = None,
    ignore_rules: list[str] = (),
    ignore_paths: list[str] = (),
    config: DataFrame | None = None,
    roots: DataFrame | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> Scan:
    """Project, code, dependency and secret findings of every repository in the corpus.

    ``replies`` adds the advisory feed. ``config`` (repo, ignore_rules, ignore_paths, fail_on) suppresses
    by repository beside the lists for the whole scan. Files over ``max_bytes`` are not read and are
    listed as errors.

    ``roots`` (root, root_ordinal) names folders and files, as paths of the repositories; ``.`` is all.
    Directories are pruned below a root only, a root that is a file is read wherever it lies, and ignore
    lines and feed ids count within a root. Each finding is listed under its first root, files are
    counted and errors listed once for each root, and roots without any file are errors.

    Text rules share one read of the corpus; the syntax facts and the manifests read only their own kind
    when the corpus is stored by kind. The facts are stored, as findings and errors both read them, so
    that each Python file is parsed once.
    """
    below = None if roots is None else _Below(corpus, roots, max_bytes)
    files = scannable(corpus, max_bytes) if below is None else below.files
    facts = stored(py_facts(python_sources(files)))
    dependencies = scan_dependencies(files, advisories)
    if replies is not None:
        dependencies = stored(dependencies)  # the feed leaves out what these findings have
    parts = [unreadable_files(files), python_findings(facts), scan_text(files), dependencies]
    errors = python_errors(facts).unionByName(manifest_errors(files))
    if below is None:
        parts.append(scan_project(corpus, tracked))
        if replies is not None:
            parts.append(scan_osv(extract_dependencies(files), replies, dependencies))
        found, stats = union_scanners(*parts), scanned_files(corpus, max_bytes)
        errors = errors.unionByName(oversized_files(corpus, max_bytes))
    else:
        # a file's own findings are the same under each of its roots
        same = union_scanners(*parts).withColumn("root_ordinal", F.lit(-1).cast("bigint"))
        of_roots = below.project(tracked)
        if replies is not None:
            of_roots = of_roots.unionByName(below.feed(extract_dependencies(files), replies, dependencies))
        found = dedupe_findings(same.unionByName(of_roots), ["repo", *DEDUPE_KEYS]).drop("root_ordinal")
        stats = below.read.groupBy("repo").agg(F.count("*").alias("scanned_files"))
        errors = below.errors(errors)
    kept = suppress(found, ignore_rules, ignore_paths)
    if config is not None:
        rules, globs, _ = suppression_tables(config)
        kept = suppress_with_tables(stored(kept), rules, globs)
    return Scan(kept, stats, errors)


class _Below:
    """What a scan of roots reads; only names and lengths of files are sorted to find it."""

    def __init__(self, corpus: DataFrame, roots: DataFrame, max_bytes: int) -> None:
        self.corpus, self.roots, self.max_bytes = corpus, roots, max_bytes
        self.rooted = stored(rt.under_roots(corpus_inventory(corpus), roots))
        opened = rt.opened(self.rooted)
        self.read, self.large = opened.where(F.col("length") <= max_bytes), opened.where(F.col("length") > max_bytes)
        self.files = only_members(corpus, stored(self.read.select("repo", "path").distinct()), ["repo", "path"])

    def project(self, tracked: DataFrame) -> DataFrame:
        """Project findings of each root that is a folder, paths and ignore lines as seen from it."""
        name = paths.basename(F.col("path"))
        inside = self.rooted.where((F.col("path") != F.col("root")) & ~paths.in_pruned_dir(rt.below_root(), paths.PROJECT_PRUNED))
        seen = [rt.scoped().alias("repo"), rt.below_root().alias("path")]
        env = inside.where(paths.is_secret_env_name(name))
        ignores = self.corpus.where(name == ".gitignore").select("repo", "path", "length", "content")
        listed = inside.where(name == ".gitignore").drop("length").join(ignores, ["repo", "path"])
        length = F.col("length").cast("bigint").alias("length")
        view = env.select(*seen, length, F.lit(None).cast("binary").alias("content")).unionByName(listed.select(*seen, length, "content"))
        index = tracked.select("repo", "path").distinct().join(env, ["repo", "path"]).select(*seen)
        found = rt.unscoped(scan_project(view, index))
        whole = F.when(F.col("root") == "", F.col("file_path")).otherwise(F.concat_ws("/", "root", "file_path"))
        return found.withColumn("file_path", whole).drop("root")

    def feed(self, deps: DataFrame, replies: DataFrame, offline: DataFrame) -> DataFrame:
        """Feed findings, each id once per root and repository."""
        places = stored(self.read.select("repo", "path", "root", "root_ordinal"))
        mine = deps.join(places, ["repo", "path"]).withColumn("repo", rt.scoped()).select(*deps.columns)
        known = offline.join(places.withColumnRenamed("path", "file_path"), ["repo", "file_path"]).withColumn("repo", rt.scoped())
        return rt.unscoped(scan_osv(mine, replies, known.select(*offline.columns))).drop("root")

    def errors(self, of_files: DataFrame) -> DataFrame:
        """Errors once for each root of their file, large files and roots without files among them."""
        places = self.read.select("repo", F.col("path").alias("file_path"))
        repeated = of_files.join(places, ["repo", "file_path"]).select("repo", "file_path", "error")
        return repeated.unionByName(too_large(self.large, self.max_bytes)).unionByName(rt.missing_roots(self.rooted, self.roots))


def fix(
    corpus: DataFrame, tracked: DataFrame, ignore_rules: list[str] = (), ignore_paths: list[str] = (),
    max_bytes: int = MAX_FILE_BYTES, python_secrets_only: bool = True, advisories: DataFrame | None = None,
    config: DataFrame | None = None, roots: DataFrame | None = None,
) -> DataFrame:
    """Patched files of a scan; the corpus itself is left alone.

    What the scan suppresses is not fixed, and files outside the roots are not touched. The fixable
    findings are stored first: the plan of fixes reads them more than once.
    """
    found = scan(
        corpus, tracked, advisories, ignore_rules=ignore_rules, ignore_paths=ignore_paths, config=config, roots=roots, max_bytes=max_bytes
    )
    return patched_files(corpus, stored(found.findings.where(F.col("fixable"))), python_secrets_only)
