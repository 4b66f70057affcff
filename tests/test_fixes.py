"""Patched files, hunks, variables, reports, trees and streams."""

import difflib
import json
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import lines, remediate as fix
from rulegrain.operators.joins import salted_join
from rulegrain.plans.scan import fix as fix_plan, scan
from rulegrain.sinks import reports
from rulegrain.sinks.documents import DocumentSink, document_name, write_documents
from rulegrain.sources import trees
from rulegrain.sources.tables import stored
from rulegrain.sources.trees import read_tree
from rulegrain.streaming import streams

APP = "import yaml\npassword = \"Tq8_vR!2mZx7Lw0\"\nrules = yaml.load(open('rules.yml'))\n"


def no_index(spark):
    return spark.createDataFrame([], "repo string, path string")


def test_end_to_end(spark, corpus_of):
    files = {"app.py": APP, "conf.yml": "password: 'Tq8_vR!2mZx7Lw0'\n", "requirements.txt": "PyYAML == 5.3.1 # x\r\nrequests==2.31.0"}
    corpus = corpus_of(files)
    rows = {r.path: r for r in fix_plan(corpus, no_index(spark)).collect()}
    assert set(rows) == {"app.py", "requirements.txt"}
    assert rows["app.py"].fixed == "import os\n" + APP.replace('"Tq8_vR!2mZx7Lw0"', 'os.environ["PASSWORD"]').replace("yaml.load", "yaml.safe_load")
    assert (rows["app.py"].change_count, rows["app.py"].import_at) == (3, 0)
    assert rows["app.py"].original == APP
    assert rows["requirements.txt"].fixed == "PyYAML==5.4 # x\nrequests==2.31.0"


def test_import_place(spark):
    texts = [
        "os.environ['A']\n", "import os\nos.environ['A']", "import os, sys\nos.environ", "  import os\nos.environ", "import osx\nos.environ\n",
        "#!/bin/x\n\n# c\nos.environ\n", "#!/bin/x\n# os.environ", "# os.environ\n", "'''doc'''\nos.environ", "nothing",
    ]
    rows = fix.ensure_os_import(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r.import_at for r in rows] == [0, None, None, None, 0, 3, 1, 0, 0, None]
    assert rows[5].text == "#!/bin/x\n\n# c\nimport os\nos.environ\n" and rows[6].text == "#!/bin/x\nimport os\n# os.environ"


def test_hunks_against_difflib(spark):
    """Line ranges equal those of a unified diff where every changed line is unlike all others."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        old = [f"line {i} {n}" for n in range(rng.randrange(1, 60))]
        new = [f"new {x}" if rng.random() < 0.12 else x for x in old]
        at = rng.choice([None, rng.randrange(len(old))])
        if at is not None:
            new.insert(at, "import os")
        rows.append((f"f{i}", "\n".join(old) + "\n", "\n".join(new) + "\n", at))
    rows = [r for r in rows if r[1] != r[2]]
    df = spark.createDataFrame([("r", *r) for r in rows], "repo string, path string, original string, fixed string, import_at int")
    got = {(r.path, r.hunk): (r.old_start, r.old_lines, r.new_start, r.new_lines) for r in fix.diff_hunks(df).collect()}
    want = {}
    for path, old, new, _ in rows:
        heads = [x for x in difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="") if x.startswith("@@")]
        for no, head in enumerate(heads, 1):
            a, b, c, d = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", head).groups()
            want[path, no] = (int(a), int(b or 1), int(c), int(d or 1))
    assert got == want


def test_variables(spark, corpus_of):
    corpus = corpus_of({"b.py": "token = 'hT6wq0Vz9LxB'\n", "a.py": "token = 'vB7xR2mQ9kLp'\nmy_key = 1\napi_key = 'vB7xR2mQ9kLp'\n", ".env.example": "MY_API_KEY=1\n"})
    found = fix.env_vars(fix_plan(corpus, no_index(spark)))
    assert {(r.name, r.value) for r in found.collect()} == {("TOKEN", "hT6wq0Vz9LxB"), ("API_KEY", "vB7xR2mQ9kLp")}
    assert [r.entry for r in fix.env_example(found, corpus).collect()] == ["TOKEN=CHANGE_ME"]


def test_reports(spark, corpus_of):
    corpus = corpus_of({"app.py": APP, "c.js": "eval(x); el.innerHTML = '\"\\u2028'", "d/package.json": "[1]", "e/package.json": "7"})
    kept = scan(corpus, no_index(spark)).kept()
    text = lambda report: "\n".join(r.text for r in report.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in reports.ORDER]).collect())
    doc = json.loads(text(reports.report_json(kept.findings, kept.stats, kept.errors)))
    assert doc["scanned_files"] == 4 and doc["summary"] == {"LOW": 0, "MEDIUM": 0, "HIGH": 3, "CRITICAL": 1} and len(doc["errors"]) == 2
    assert [f["rule_id"] for f in doc["findings"]] == ["JS003", "SEC006", "PY006", "JS001"] and doc["findings"][0]["file"] == "c.js"
    sarif = json.loads(text(reports.report_sarif(kept.findings, kept.stats)))
    assert [r["level"] for r in sarif["runs"][0]["results"]] == ["error"] * 4
    assert sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1}
    listing = text(reports.report_listing(kept.findings, kept.stats, kept.errors))
    assert "c.js:1\n  JS003 (critical, CWE-95)" in listing and "(1 critical, 3 high, 0 medium, 0 low)" in listing and listing.count("not read: ") == 2
    empty = json.loads(text(reports.report_json(kept.findings.limit(0), kept.stats, kept.errors.limit(0))))
    assert empty["findings"] == [] and empty["errors"] == []


def test_written_report_reads_in_order(spark, corpus_of, tmp_path):
    corpus = corpus_of({f"f{i}.js": "eval(x)\n" * 20 for i in range(30)})
    kept = scan(corpus, no_index(spark)).kept()
    reports.write_report(reports.report_json(kept.findings, kept.stats, kept.errors), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "repo=r").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert [(f["file"], f["line"]) for f in doc["findings"]] == sorted((f"f{i}.js", n) for i in range(30) for n in range(1, 21))


def test_whole_documents(spark, corpus_of, tmp_path):
    """A document a repository, each as its rows in order, whatever the repository is called."""
    hot = corpus_of({f"f{i:02}.js": "eval(x)\n" * 40 for i in range(40)}, "a/b .c")
    corpus = hot.unionByName(corpus_of({"x.js": "eval('\\n')"}, "a")).unionByName(corpus_of({"y.txt": "calm"}, "..")).unionByName(corpus_of({"z.js": "eval(1)"}, ""))
    kept = scan(corpus, no_index(spark)).kept()
    report = stored(reports.report_json(kept.findings, kept.stats, kept.errors))
    write_documents(report, str(tmp_path / "out"))
    ordered = report.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in reports.ORDER]).collect()
    want = {document_name(repo, ".json"): "".join(f"{r.text}\n" for r in ordered if r.repo == repo) for repo in ("a/b .c", "a", "..", "")}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == want and len(want) == 4
    found = json.loads((tmp_path / "out" / "a%2Fb %2Ec.json").read_text())["findings"]
    assert len(found) == 1600 and [f["file"] for f in found] == sorted(f["file"] for f in found)
    with pytest.raises(FileExistsError):
        write_documents(report, str(tmp_path / "out"))
    write_documents(report.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*"))
    again = "file://" + str(tmp_path / "again")
    write_documents(reports.report_sarif(kept.findings, kept.stats), again, ".sarif")
    assert len(json.loads((tmp_path / "again" / "a.sarif").read_text())["runs"][0]["results"]) == 1


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    """One of two documents can't be put together: neither is there, nor any attempt; another write then succeeds."""
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "part-0").write_text("{}")
    rows = [("good", str(tmp_path / "parts")), ("bad", str(tmp_path / "missing"))]
    spark.dataSource.register(DocumentSink)
    save = lambda n: spark.createDataFrame(rows[:n], DocumentSink({}).schema()).repartition(2, "repo").write.format(DocumentSink.name()).mode("append").option("uri", str(tmp_path / "out")).option("suffix", ".json").save()
    with pytest.raises(Exception, match="missing"):
        save(2)
    assert not list((tmp_path / "out").glob("*"))
    save(1)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["good.json"] and (tmp_path / "out" / "good.json").read_text() == "{}"


def test_tree(spark, tmp_path):
    for path, body in {".env": b"A", "src/a.py": b"eval(x)\n", ".git/x": b"", "src/.gitignore": b"x\n", "build/b.js": b"eval(x)"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    corpus = read_tree(spark, {"r": str(tmp_path)})
    assert {(r.path, r.length) for r in corpus.collect()} == {(".env", 1), ("src/a.py", 8), ("src/.gitignore", 2), ("build/b.js", 7)}
    assert {(r.file_path, r.rule_id) for r in scan(corpus, no_index(spark)).findings.collect()} == {(".env", "PRJ001"), ("src/a.py", "PY001")}


def test_one_folder_with_most_files_is_read_by_many_tasks(spark, tmp_path):
    """Listing in rounds of a few entries, and files dealt by bytes, give the tree that a plain walk gives."""
    rng = random.Random(2)
    sizes = {f"big/f{i}.js": 3000 for i in range(300)} | {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) + f"/n{i}.py": i for i in range(60)}
    sizes |= {"huge.js": 90_000, ".env": 4, "node_modules/x.js": 5, "build/.gitignore": 6}
    for path, size in sizes.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_bytes(b"x" * size)
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    (tmp_path / "t" / "gone.js").symlink_to(tmp_path / "nowhere")
    corpus = trees.read_tree(spark, {"r": str(tmp_path / "t"), "none": str(tmp_path / "missing")}, max_bytes=50_000, limit=10, task_bytes=200_000)
    rows = corpus.withColumn("task", F.spark_partition_id()).collect()
    assert {r.path: r.length for r in rows} == {p: n for p, n in sizes.items() if not p.startswith("node_modules/")} | {"gone.js": 0}
    assert {r.path for r in rows if r.content is None} == {"huge.js", "gone.js"} and len(rows) == len({r.path for r in rows})
    assert len({r.task for r in rows if r.path.startswith("big/")}) >= 8
    assert trees.read_tree(spark, {}).count() == 0


def test_salted_join_keeps_every_pair(spark):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 7}", i) for i in range(300)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, j int")
    got = salted_join(left, right, ["k"], "inner", [F.col("i")]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right, "k").select("k", "i", "j").collect()))
    anti = salted_join(left, right, ["k"], "left_anti", [F.col("i")])
    assert anti.columns == ["k", "i"] and anti.count() == left.join(right, "k", "left_anti").count()


EVENTS = "ts timestamp, rule_id string, file_path string, line int, `column` int, severity string, severity_rank int"


def event_files(spark, folder):
    rows = [
        (f"2024-01-01 0{i % 5}:{i % 60:02d}:00", "A" if i % 3 else "HOT", f"f{i % 4 if i % 3 else 0}", 1, 1, ["LOW", "HIGH"][i % 2], 1 + 2 * (i % 2))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_equal_batch(spark, tmp_path):
    batch, stream = event_files(spark, str(tmp_path / "events"))
    want = batch.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "severity").count()
    # Files arrive in any order of time: the delay spans the data, so nothing is late.
    counts = streams.stream_severity(stream, delay="2 days")
    folder = str(tmp_path / "counts")
    streams.each_batch(counts, folder, lambda b: b, "update").awaitTermination()
    got = spark.read.parquet(folder + "/rows").groupBy("window_start", "severity").agg(F.max_by("n", "batch").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    gates = streams.stream_gate(stream, "HIGH").collect()
    assert sum(g.findings for g in gates) == 300 and len(gates) == 3 and {g.exit_code for g in gates} == {2}


def test_stream_scan(spark, tmp_path):
    texts = spark.createDataFrame(
        [("r", f"{i}.js", "eval(x)\ntoken = 'hT6wq0Vz9LxB'\n") for i in range(20)] + [("r", "a.txt", "eval(x)")], "repo string, path string, text string"
    )
    texts.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = streams.run_scan(stream)
    assert sorted((r.file_path, r.rule_id, r.line) for r in got.collect()) == sorted(
        (f"{i}.js", rule, line) for i in range(20) for rule, line in (("JS003", 1), ("SEC006", 2))
    )


def test_lines_of_an_uneven_corpus(corpus_of):
    """One file holds most lines; none is lost or cut."""
    corpus = corpus_of({"hot.js": "eval(x)\n" * 50_000, "b.js": "eval(x)"})
    assert lines.scan_code(corpus).groupBy("file_path").count().orderBy("count").collect()[-1]["count"] == 50_000


def test_equal_findings_are_listed_once(spark, corpus_of):
    kept = scan(corpus_of({"c.js": "eval(x); panel.innerHTML = y"}), no_index(spark)).kept()
    twice = kept.findings.unionByName(kept.findings)
    for report in (reports.report_json(twice, kept.stats, kept.errors), reports.report_sarif(twice, kept.stats)):
        rows = report.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in reports.ORDER]).collect()
        doc = json.loads("".join(r.text for r in rows))
        assert len(doc.get("findings", doc.get("runs", [{}])[0].get("results"))) == 2


def test_large_files_leave_a_trace(spark, corpus_of):
    corpus = corpus_of({"a.js": "eval(x)", "b.js": "eval(x)" + " " * 50, "c.bin": "x" * 99})
    found = scan(corpus, no_index(spark), max_bytes=20)
    assert [r.file_path for r in found.findings.collect()] == ["a.js"]
    assert [(r.file_path, r.error) for r in found.errors.collect()] == [("b.js", "not read: 57 bytes, over the limit of 20")]
    assert found.stats.collect()[0].scanned_files == 1


def test_secrets_outside_python_on_request(spark, corpus_of):
    corpus = corpus_of({"conf.yml": "password: 'Tq8_vR!2mZx7Lw0'\n"})
    assert fix_plan(corpus, no_index(spark)).count() == 0
    assert fix_plan(corpus, no_index(spark), python_secrets_only=False).collect()[0].change_count >= 1


def test_workers_get_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from rulegrain.operators.pyfacts import py_facts
rows = py_facts(spark.createDataFrame([("r", "a.py", "eval(x)")], "repo string, path string, text string")).collect()
assert rows[0].name == "eval"
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
