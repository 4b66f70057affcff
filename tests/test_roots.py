"""Scans of some roots, and the filter that keeps contents out of shuffles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import membership, remediate, roots as rt
from rulegrain.plans.scan import fix, scan

TRACKED = "repo string, path string"


def roots_of(spark, *names):
    return spark.createDataFrame(list(zip(names, range(len(names)))), "root string, root_ordinal bigint")


def test_files_of_each_root_agree_with_a_plain_test(spark):
    rng = random.Random(4)
    names = ["a", "b", "a-b", "a.b", "build", "x y", "a0"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(300)} | {"a", "a/a", "a-b/a"}
    files = spark.createDataFrame([(f"r{i % 3}", p) for i, p in enumerate(sorted(paths))] + [("r9", "a/a"), ("r8", "a/a")], "repo string, path string")
    listed = ["a", "a/a", "./a/", "a/b/", ".", "x y/a", "none", "a-b", "a/a/a/a", "a"]
    found = sorted((r.repo, r.path, r.root, r.root_ordinal) for r in rt.under_roots(files, roots_of(spark, *listed)).collect())
    clean = [(r.removeprefix("./").rstrip("/") if r != "." else "", i) for i, r in enumerate(listed)]
    expected = [(f.repo, f.path, r, i) for f in files.collect() for r, i in clean if r == "" or f.path == r or f.path.startswith(r + "/")]
    assert found == sorted(expected) and len({i for *_, i in found}) >= 8


@pytest.fixture(scope="module")
def tree(corpus_of):
    return corpus_of({
        "build/a.js": "eval(x)", "src/b.js": "eval(y)", "src/c.js": "eval(z)", "src/node_modules/d.js": "eval(d)", "build/dist/e.js": "eval(e)",
        "env/.env": "A=1", "env/sub/.env": "A=1", "env/sub/.gitignore": ".env\n", "node_modules/.env": "A=1", "src/big.js": "eval(b)" + " " * 3000,
        "m/package.json": "[1, 2]", "app.py": "import yaml\nyaml.load(s)\n", "build/app.py": "import yaml\nyaml.load(s)\n",
    })


def test_a_root_inside_a_pruned_folder_a_file_and_a_missing_one(spark, tree):
    none = spark.createDataFrame([], TRACKED)
    result = scan(tree, none, roots=roots_of(spark, "build/", "src/b.js", "gone"), max_bytes=2000)
    assert {(r.file_path, r.rule_id) for r in result.findings.collect()} == {("build/a.js", "JS003"), ("src/b.js", "JS003"), ("build/app.py", "PY006")}
    assert result.stats.first().scanned_files == 3
    assert [(r.file_path, r.error) for r in result.errors.collect()] == [("gone", "path not found: gone")]


def test_counts_and_errors_repeat_with_the_roots(spark, tree):
    none = spark.createDataFrame([], TRACKED)
    result = scan(tree, none, roots=roots_of(spark, "src", ".", "src/b.js", "m", "src/node_modules"), max_bytes=2000)
    found = sorted((r.file_path, r.rule_id) for r in result.findings.collect())
    assert found == [
        ("app.py", "PY006"), ("src/b.js", "JS003"), ("src/c.js", "JS003"), ("src/node_modules/d.js", "JS003"),
    ]
    assert result.stats.first().scanned_files == 2 + 4 + 1 + 1 + 1
    assert sorted(r.file_path for r in result.errors.collect()) == ["m/package.json"] * 2 + ["src/big.js"] * 2


def test_ignore_lines_count_within_a_root(spark, tree):
    """What the whole tree ignores is exposed below a root that holds no ignore file."""
    index = spark.createDataFrame([("r", "env/.env")], TRACKED)
    exposed = lambda *names: sorted((r.file_path, r.rule_id) for r in scan(tree, index, roots=roots_of(spark, *names)).findings.where("category = 'project'").collect())
    assert exposed(".") == [("env/.env", "PRJ002")]
    assert exposed("env/sub") == [] and exposed("env/.env") == []
    assert exposed("node_modules", "env") == [("env/.env", "PRJ002"), ("node_modules/.env", "PRJ001")]


def test_feed_ids_count_within_a_root(spark, corpus_of):
    corpus = corpus_of({f"{d}/requirements.txt": "pkg==1.0\n" for d in ("a", "b", "c")})
    body = json.dumps({"vulns": [{"id": "X-1", "summary": "s"}]})
    replies = spark.createDataFrame([("PyPI", "pkg", "1.0", body)], "ecosystem string, name string, version string, body string")
    none = spark.createDataFrame([], TRACKED)
    places = lambda *names: sorted(r.file_path for r in scan(corpus, none, replies=replies, roots=roots_of(spark, *names)).findings.collect())
    assert places(".") == ["a/requirements.txt"]
    assert places("b", "c", ".") == ["a/requirements.txt", "b/requirements.txt", "c/requirements.txt"]


def test_fixes_keep_to_the_roots_and_to_what_is_not_suppressed(spark, tree):
    none = spark.createDataFrame([], TRACKED)
    assert [r.path for r in fix(tree, none, roots=roots_of(spark, "build")).collect()] == ["build/app.py"]
    assert [r.path for r in fix(tree, none).collect()] == ["app.py"]
    config = spark.createDataFrame([("r", ["PY006"], [], "")], "repo string, ignore_rules array<string>, ignore_paths array<string>, fail_on string")
    assert fix(tree, none, config=config).count() == 0


def test_the_filter_lets_all_members_through_and_few_others(spark):
    facts = spark.range(200_000).selectExpr("concat('r', id % 7) AS repo", "id", "repeat('x', 10) AS content")
    keys = spark.range(0, 200_000, 40).selectExpr("concat('r', id % 7) AS repo", "id")
    left = membership.may_be_in(facts, keys, ["repo", "id"])
    members = left.join(keys, ["repo", "id"], "left_semi").count()
    assert members == keys.count() and left.count() < members * 1.25 and left.columns == facts.columns
    assert membership.filter_blocks(keys, ["repo", "id"], limit=100) is None
    assert membership.only_members(facts, keys, ["repo", "id"], limit=100).count() == members
    assert membership.only_members(facts, keys.limit(0), ["repo", "id"]).count() == 0
    odd = spark.createDataFrame([(None, 1), ("r", None)], "repo string, id bigint")
    assert membership.only_members(odd, odd, ["repo", "id"]).count() == 0


def test_contents_are_filtered_before_they_are_shuffled(spark):
    """With broadcast joins off, the first thing above a read of contents or lines is the filter, not an exchange."""
    tree = spark.createDataFrame([("r", "a.py", 1, bytearray(b"x"))], "repo string, path string, length bigint, content binary")
    schema = "repo string, file_path string, line int, rule_id string, fixable boolean, ordinal bigint, `column` int, snippet string, category string, remediation string"
    found = spark.createDataFrame([("r", "a.py", 1, "PY006", True, 1, 1, "x", "sast", "")], schema)
    lines = tree.selectExpr("repo", "path", "1 AS line", "cast(content AS string) AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            remediate.patched_files(tree, found), remediate.fix_candidate_files(tree, found), remediate.line_fold(found, lines),
            remediate.join_fixers(found, lines),
        ]
        plans = [df._jdf.queryExecution().executedPlan().toString().splitlines() for df in plans]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    place = lambda line: max(line.find("+- "), line.find(":- "))
    for plan in plans:
        nodes = [line for line in plan if place(line) >= 0]
        (read,) = [i for i, line in enumerate(nodes) if "Scan ExistingRDD[repo" in line and "content#" in line]
        level, above = place(nodes[read]), []
        for line in reversed(nodes[:read]):
            if place(line) < level:
                level = place(line)
                above.append(line.strip(" :+-").split("(")[0].split()[0])
        moves = [n for n in above if n in ("Exchange", "BroadcastHashJoin")]
        assert moves[0] == "BroadcastHashJoin", above
