"""Operators over tables: dependencies, feed, project, responses, findings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import dependencies as deps, findings as fs, globs, joins, osv, project, responses
from rulegrain.operators.tries import PathTrie
from rulegrain.plans.scan import scan
from rulegrain.schema import as_findings
from test_functions import PATHS, PATTERNS, ignored, suppressed


@pytest.fixture(params=[50_000, 0], ids=["broadcast", "salted"])
def either_join(request, monkeypatch):
    """Run a test with lookups small enough to broadcast, and with every lookup too large for it."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", request.param)


def make(spark, rows, columns="repo string, rule_id string, severity string, file_path string, line int"):
    return as_findings(spark.createDataFrame(rows, columns).withColumn("message", F.lit("m")))


def test_manifests(corpus_of, either_join, spark):
    corpus = corpus_of({
        "requirements.txt": "PyYAML==5.3.1\r\n# x\n-r a\n  requests == 2.31.0 # y\nflask>=2\nDjango==4.2.7rc1\n-e==1\n",
        "a/package.json": '{"dependencies": {"lodash": "^4.17.20", "n": 1.5, "x": "*"}, "devDependencies": {"minimist": "1.2.6"}}',
        "b/package.json": "{", "c/package.json": "[1]", "d/package.json": '{"dependencies": ["a"]}', "e/package.json": '{"dependencies": null}',
        "f/requirements.txt": b"\xff==1", "g/package.json": '{"dependencies": {"lodash": "1"}} x', "h/package.json": "[1]]", "i/package.json": "",
    })
    got = deps.scan_dependencies(corpus).select("rule_id", "file_path", "line", "severity", "remediation").collect()
    assert sorted(map(tuple, got)) == [
        ("CVE-2020-14343", "requirements.txt", 1, "CRITICAL", "Upgrade PyYAML to >= 5.4."),
        ("CVE-2021-23337", "a/package.json", 0, "HIGH", "Upgrade lodash to >= 4.17.21."),
    ]
    table = deps.scan_dependencies(corpus, deps.advisory_table(spark)).select("rule_id", "file_path", "line", "severity", "remediation")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, got))
    assert {r.file_path for r in deps.manifest_errors(corpus).collect()} == {"c/package.json", "d/package.json", "f/requirements.txt"}
    pins = {(r.ecosystem, r.name, r.version) for r in deps.extract_dependencies(corpus).collect()}
    assert pins >= {("PyPI", "-e", "1"), ("npm", "n", "1.5"), ("PyPI", "Django", "4.2.7rc1")}


def reply(*vulns):
    return json.dumps({"vulns": list(vulns)})


def test_feed(spark, either_join):
    flask = {
        "id": "GHSA-a", "summary": "\n Bad.\nMore", "database_specific": {"severity": "moderate"},
        "affected": [{"package": {"name": "Flask"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.3.2"}]}]}],
    }
    scored = {"id": "X", "severity": [{"type": "V3", "score": "CVSS:3.1/AV:N"}, {"score": "9.8"}], "affected": []}
    replies = spark.createDataFrame(
        [("PyPI", "flask", "1", reply(flask, scored)), ("PyPI", "b", "1", reply({"summary": "  "})), ("PyPI", "c", "1", '{"vulns": []}'), ("PyPI", "d", "1", "oops")],
        "ecosystem string, name string, version string, body string",
    )
    pins = spark.createDataFrame(
        [("r", "b.txt", "PyPI", "flask", "1", 3, 3), ("r", "a.txt", "PyPI", "flask", "1", 7, 7), ("r", "a.txt", "PyPI", "b", "1", 1, 1), ("s", "z.txt", "PyPI", "flask", "1", 1, 1)],
        "repo string, path string, ecosystem string, name string, version string, line int, position bigint",
    )
    known = make(spark, [("s", "GHSA-a", "HIGH", "z.txt", 1)]).withColumn("category", F.lit("dependency"))
    rows = osv.scan_osv(pins, replies, known).orderBy("repo", "rule_id").collect()
    assert [(r.repo, r.rule_id, r.severity, r.file_path, r.line, r.fixable) for r in rows] == [
        ("r", "GHSA-a", "MEDIUM", "a.txt", 7, True), ("r", "OSV-UNKNOWN", "MEDIUM", "a.txt", 1, False),
        ("r", "X", "CRITICAL", "a.txt", 7, False), ("s", "X", "CRITICAL", "z.txt", 1, False),
    ]
    assert rows[0].message == "flask 1 falls under a published advisory. Bad." and rows[0].remediation == "Upgrade flask to >= 2.3.2."
    assert rows[1].message.endswith("Known vulnerability.")


def test_project(spark, corpus_of, either_join):
    def ids(files, tracked=()):
        index = spark.createDataFrame([("r", p) for p in tracked], "repo string, path string")
        return {(r.rule_id, r.file_path) for r in project.scan_project(corpus_of(files), index).collect()}

    assert ids({".env": "A=1"}) == {("PRJ001", ".env")}
    assert ids({".env": "A=1", ".gitignore": ".env\n"}) == set()
    assert ids({".env": "A=1", ".gitignore": "*.env\n.env*\n"}) == set()
    assert ids({".env.example": "A=1"}) == set()
    assert ids({".env": "A=1", ".gitignore": ".env\n"}, [".env"]) == {("PRJ002", ".env")}
    assert ids({"build/.env": "A=1", "venv/.env": "A=1", ".gitignore": "!build\n# .env\n"}) == {("PRJ001", "build/.env")}
    assert ids({"a/.env": "", "x/.gitignore": "/\n"}) == set()


ODD_PATTERNS = ["", "*", "src/", "a/b/.env*", "src/l*/x.py", "*/legacy/*", "src/legacy", "sr", "a/", "b/.env.local", "/a/b", "caf\u00e9/*", "dir.d/", "a//b/", "//"]
ODD_PATHS = ["", "/", "a//b/c", "/src/app.js", "x/src/legacy/x.py", "a/b", "src/legacy/y/z.py"]


def test_tries_against_every_pair():
    """Each pattern alone, and all patterns that cover nothing of a path together."""
    for path in [*PATHS, *ODD_PATHS]:
        for add, covers in ((PathTrie.add_ignore, ignored), (PathTrie.add_suppression, suppressed)):
            others = PathTrie()
            for pattern in [*PATTERNS, *ODD_PATTERNS]:
                trie = PathTrie()
                add(trie, pattern)
                assert trie.covers(path) == covers(path, pattern), (path, pattern, add)
                if not covers(path, pattern):
                    add(others, pattern)
            assert not others.covers(path)


@pytest.mark.parametrize(["broadcast", "block"], [(4_000_000, 8_000_000), (0, 8_000_000), (0, 60)])
def test_glob_tables_against_every_pair(spark, monkeypatch, broadcast, block):
    """One repository holds a third of all paths and patterns; its patterns fit in one trie, or need several."""
    monkeypatch.setattr(globs, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(globs, "BLOCK_BYTES", block)
    rng = random.Random(5)
    repos = ["hot"] * 10 + [f"r{i}" for i in range(20)]
    files = sorted({(rng.choice(repos), p) for p in PATHS for _ in range(12)})
    patterns = sorted({(rng.choice(repos), p) for p in PATTERNS for _ in range(3)})
    f = spark.createDataFrame(files, "repo string, path string")
    p = spark.createDataFrame(patterns, "repo string, pattern string")
    for operator, covers in ((globs.ignored_files, ignored), (globs.suppressed_files, suppressed)):
        want = sorted({(r, path) for r, path in files if any(r == q and covers(path, g) for q, g in patterns)})
        found = operator(f, p)
        assert sorted(map(tuple, found.collect())) == want
        # paths are never exploded into pieces; those of broadcast patterns are not shuffled before they are walked
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert ("Generate" not in plan and "Exchange" not in plan.split("MapInArrow")[1]) == bool(broadcast)
    empty = (f.limit(0), p), (f, p.limit(0)), (f.withColumn("path", F.lit(None).cast("string")), p), (f, p.withColumn("pattern", F.lit(None).cast("string")))
    for few, none in empty:
        assert globs.ignored_files(few, none).count() == 0


def test_responses(spark):
    def ids(url, headers, cookies=()):
        df = spark.createDataFrame([(url, 200, headers, list(cookies))], "url string, status int, headers map<string,string>, cookies array<string>")
        return sorted(r.rule_id for r in responses.scan_responses(df).collect())

    assert ids("http://example.com", {}) == ["DAST002", "DAST003", "DAST004", "DAST008"]
    assert ids("https://example.com", {}) == ["DAST001", "DAST002", "DAST003", "DAST004"]
    safe = {
        "strict-transport-security": "max-age=1", "Content-Security-Policy": "default-src 'self'; FRAME-ancestors 'none'",
        "X-Content-Type-Options": "NOSNIFF",
    }
    assert ids("https://example.com", safe) == []
    assert ids("https://example.com", safe | {"Server": "nginx/1.18.0", "x-powered-by": "PHP/8", "X-AspNet-Version": "x"}) == ["DAST005"] * 2
    assert ids("https://e", safe, ["a=1; Path=/", "b=2; Secure; HttpOnly", "c; secure"]) == ["DAST006", "DAST007", "DAST007"]
    assert ids("http://e", safe, ["a=1"]) == ["DAST007", "DAST008"]
    assert ids("HTTPS://e", safe | {"x-content-type-options": " nosniff"})[-1:] in ([], ["DAST003"])


def test_suppression(spark, either_join):
    rows = [("r", "PY001", "HIGH", "src/app.py", 1), ("r", "PY002", "HIGH", "legacy/old.py", 1), ("s", "PY001", "HIGH", "static/app.min.js", 1)]
    f = make(spark, rows)
    left = lambda df: {(r.repo, r.file_path) for r in df.collect()}
    assert left(fs.suppress(f, ["PY001"], ["legacy/"])) == set()
    assert left(fs.suppress(f, [], ["*.min.js"])) == {("r", "src/app.py"), ("r", "legacy/old.py")}
    config = spark.createDataFrame(
        [("r", ["PY001"], ["*.min.js"], "high"), ("s", [], ["*.min.js", "x/"], None), ("t", [], [], "")],
        "repo string, ignore_rules array<string>, ignore_paths array<string>, fail_on string",
    )
    rules, paths, gates = fs.suppression_tables(config)
    assert left(fs.suppress_with_tables(f, rules, paths)) == {("r", "legacy/old.py")}
    assert [tuple(r) for r in gates.collect()] == [("r", "HIGH")]


def test_counts_gate_and_order(spark):
    f = make(spark, [("r", "A", "HIGH", "b", 2), ("r", "B", "LOW", "a", 1), ("r", "A", "HIGH", "a", 9), ("r", "C", "HIGH", "a", 9)])
    assert [(r.severity, r.n) for r in fs.severity_desc(f).collect()] == [("CRITICAL", 0), ("HIGH", 3), ("MEDIUM", 0), ("LOW", 1)]
    assert [(r.file_path, r.line, r.rule_id) for r in fs.sorted_findings(f).collect()] == [("a", 9, "A"), ("a", 9, "C"), ("b", 2, "A"), ("a", 1, "B")]
    code = lambda *levels: fs.gate(f, *levels).first().exit_code
    assert [code("HIGH"), code("CRITICAL"), code(None), code("odd"), code(None, "LOW"), code("CRITICAL", "LOW")] == [2, 0, 0, 0, 2, 0]
    assert fs.gate(f.limit(0), "LOW").first().exit_code == 0


def test_dedupe_of_a_hot_key(spark):
    """A third of all rows share one key; the first by root and ordinal stays."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        key = ("A", "hot", 1, 1) if i % 3 == 0 else (rng.choice("AB"), f"f{rng.randrange(50)}", rng.randrange(5), 1)
        rows.append((*key, rng.randrange(10), i, f"s{i}"))
    df = spark.createDataFrame(rows, "rule_id string, file_path string, line int, `column` int, root_ordinal int, ordinal bigint, snippet string")
    want = {}
    for row in sorted(rows, key=lambda r: (r[4], r[5])):
        want.setdefault(row[:4], row)
    assert sorted(map(tuple, fs.dedupe_findings(df).collect())) == sorted(want.values())


def test_overlapping_roots(spark, either_join):
    f = make(spark, [("r", "A", "HIGH", "src/a.py", 1), ("r", "A", "HIGH", "b.py", 1)])
    roots = spark.createDataFrame([("src/", 0), (".", 1), ("src/a.py", 2), ("nope", 3)], "root string, root_ordinal bigint")
    assert sorted(r.file_path for r in fs.merge_roots(f, roots).collect()) == ["b.py", "src/a.py"]
    files = spark.createDataFrame([("src/a.py", 1), ("b.py", 1), ("build/c.py", 1), ("x.md", 1)], "path string, length bigint")
    assert fs.scan_totals(files, roots).first()[0] == 4
    direct = spark.createDataFrame([("build/c.py", 0), ("build", 1)], "root string, root_ordinal bigint")
    assert fs.scan_totals(files, direct).first()[0] == 2
    assert [r.file_path for r in fs.missing_roots(files, roots).collect()] == ["nope"]


def test_whole_scan(spark, corpus_of):
    corpus = corpus_of({
        "app.py": "import yaml\npassword = 'Tq8_vR!2mZx7Lw0'\nyaml.load(open('c'))\n", "node_modules/x.js": "eval(x)",
        ".env": "A=1", "requirements.txt": "flask==2.0.0\n", "big.js": "eval(x)" + " " * 2_000_000, "c/package.json": "[]1",
    })
    none = spark.createDataFrame([], "repo string, path string")
    result = scan(corpus, none)
    assert {(r.file_path, r.rule_id) for r in result.findings.collect()} == {
        ("app.py", "PY006"), ("app.py", "SEC006"), (".env", "PRJ001"), ("requirements.txt", "CVE-2023-30861"),
    }
    assert result.stats.first().scanned_files == 3 and [r.file_path for r in result.errors.collect()] == ["big.js"]
    kinds = corpus.transform(__import__("rulegrain.sources.corpus", fromlist=["x"]).with_kind)
    assert scan(kinds, none).findings.count() == 4
    assert {r.rule_id for r in scan(corpus, none, ignore_rules=["PY006"], ignore_paths=["*.txt"]).findings.collect()} == {"SEC006", "PRJ001"}


def test_long_reply_keeps_its_order(spark):
    """The hundredth and later advisories of a reply still have their own rank."""
    vulns = [{"id": f"V{i}", "summary": f"s{i}"} for i in range(150)]
    vulns[120]["id"] = vulns[130]["id"] = "SAME"
    deps = spark.createDataFrame([("r", "p/requirements.txt", "PyPI", "a", "1", 1, 1)], "repo string, path string, ecosystem string, name string, version string, line int, position bigint")
    replies = spark.createDataFrame([("PyPI", "a", "1", json.dumps({"vulns": vulns}))], "ecosystem string, name string, version string, body string")
    found = osv.osv_findings(osv.match_feed(deps, osv.osv_feed(replies)))
    assert found.select("ordinal").distinct().count() == 150
    first = osv.first_per_id(found, ["repo"])
    assert [r.message for r in first.where("rule_id = 'SAME'").collect()] == ["a 1 falls under a published advisory. s120"]


def test_versions_of_any_length(spark):
    from rulegrain.functions.versions import compare_version

    pairs = [("9" * 60, "1", 1), ("1" + "0" * 60, "9" * 60, 1), ("0" * 50 + "7", "7", 0), ("2." + "3" * 45, "2." + "3" * 44 + "4", -1)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in rows.select(compare_version(F.col("a"), F.col("b"))).collect()] == [c for _, _, c in pairs]


def test_the_corpus_of_a_scan_is_stored_by_kind(spark, tmp_path):
    """A reader of one kind opens the files of that kind alone; the rows are those of the tables."""
    from rulegrain.plans import derive
    from rulegrain.plans.catalog.rules import scan_corpus
    from rulegrain.sources.corpus import with_kind

    spark.range(1, 60).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 20).selectExpr("id AS p_partkey", "int(id % 5) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(1, 20).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    made = [part(spark, str(tmp_path)) for part in (derive.code_corpus, derive.manifest_corpus, derive.tree_files)]
    want = with_kind(made[0].unionByName(made[1]).unionByName(made[2]))
    got = scan_corpus(spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    python = got.where("kind = 'python'")
    assert python.count() > 0 and all("/kind=python/" in f.file for f in python.selectExpr("_metadata.file_path AS file").collect())
    assert len(got.inputFiles()) > len({f.file for f in python.selectExpr("_metadata.file_path AS file").collect()})
