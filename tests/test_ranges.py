"""Version ranges as an interval index, and global ranks."""

import random

from pyspark.sql import functions as F

from rulegrain.functions.versions import compare_version, parse_version, satisfies
from rulegrain.operators import ranges as rg
from rulegrain.operators.dependencies import join_advisory
from rulegrain.operators.ranks import ranked

RANGES = "ecosystem string, package string, op string, bound string, id string"


def tables(spark, n_versions, n_ranges, seed=3):
    rng = random.Random(seed)
    version = lambda: ".".join(str(rng.choice([0, 1, 2, 10, 99, 10**30])) for _ in range(rng.randrange(1, 4)))
    deps = [("pypi", f"P{i % 2}", version(), "r", f"f{i}", i, i) for i in range(n_versions)] + [("npm", "P0", "1.0", "r", "g", 1, 1), ("pypi", "P0", None, "r", "h", 1, 1)]
    ops = ["<", "<=", ">", ">=", "==", "~"]
    rows = [("pypi", f"p{i % 3}", rng.choice(ops), rng.choice([version(), "1.0.0", "x", ""]), f"A{i}") for i in range(n_ranges)] + [("pypi", "p0", "<", None, "N"), ("pypi", "p0", None, "1", "M")]
    deps = spark.createDataFrame(deps, "ecosystem string, name string, version string, repo string, path string, position bigint, line int")
    ranges = spark.createDataFrame(rows, RANGES).withColumn("bound_key", parse_version(F.col("bound")))
    return deps, ranges


def test_text_of_a_version_sorts_as_the_version(spark):
    rng = random.Random(1)
    texts = ["", "0", "0.0", "1", "1.0", "1.0.0", "1.0.1", "1.10", "1.9", "01.1", "9" * 40, "1" + "0" * 40, "0.0.3", "x.2"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(300)]
    a, b = (rg.version_order(parse_version(F.col(c))) for c in "ab")
    order = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", order.alias("got"), compare_version(F.col("a"), F.col("b")).alias("want"))
    assert [r for r in rows.collect() if r.got != r.want] == []


def test_ranges_that_cover_a_version_and_no_others(spark):
    deps, ranges = tables(spark, 300, 400)
    got = sorted((r.path, r.position, r.id) for r in join_advisory(deps, ranges).collect())
    pairs = deps.withColumn("package", F.lower("name")).join(ranges, ["ecosystem", "package"])
    want = pairs.where(satisfies(parse_version(F.col("version")), F.col("op"), F.col("bound_key")))
    assert got == sorted((r.path, r.position, r.id) for r in want.collect()) and len(got) > 1000


def test_many_ranges_of_one_package(spark):
    """100,000 ranges of which few cover a version: the join of blocks makes the covering rows and no more."""
    ranges = spark.range(100_000).selectExpr("'pypi' AS ecosystem", "'p' AS package", "'==' AS op", "concat(id div 100, '.', id % 100) AS bound", "concat('A', id) AS id")
    ranges = ranges.withColumn("bound_key", parse_version(F.col("bound")))
    deps = spark.range(200).selectExpr("'pypi' AS ecosystem", "'p' AS package", "concat(id * 3, '.', id % 50) AS version").withColumn("version_key", parse_version(F.col("version")))
    assert rg.covering(deps, ranges).count() == 200
    below = ranges.withColumn("op", F.lit("<"))
    assert rg.covering(deps.limit(20), below).count() == sum(100_000 - (i * 300 + i % 50) - 1 for i in range(20))


def test_ranks_count_all_rows(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS a", "hash(id) AS b", "id").repartition(7)
    got = ranked(rows, [F.col("a").desc(), F.col("b"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.a, r.b, r.id) for r in got] == [tuple(r) for r in rows.orderBy(F.col("a").desc(), "b", "id").collect()]
    assert ranked(rows.limit(0), [F.col("id")]).count() == 0


def test_many_results_by_any_way(spark, monkeypatch):
    """Facts meet ranges by blocks where the result is large: facts broadcast, ranges repeated, or facts repeated; copies count."""
    deps, ranges = tables(spark, 120, 60)
    deps = deps.unionByName(deps.limit(30))
    ranges = ranges.unionByName(ranges.limit(5))
    monkeypatch.setattr(rg, "BROADCAST_ROWS", 10)
    for limit, rows in ((10**6, deps), (0, deps), (0, deps.where("position < 4"))):
        pairs = rows.withColumn("package", F.lower("name")).join(ranges, ["ecosystem", "package"])
        held = pairs.where(satisfies(parse_version(F.col("version")), F.col("op"), F.col("bound_key")))
        monkeypatch.setattr(rg, "INDEX_ROWS", limit)
        got = join_advisory(rows, ranges).collect()
        assert sorted((r.path, r.position, r.id) for r in got) == sorted((r.path, r.position, r.id) for r in held.collect()) and len(got) > 10


def test_a_large_result_is_not_shuffled_again(spark, monkeypatch):
    """Results of an advisory lie together, so counting by advisory moves no row of the result."""
    monkeypatch.setattr(rg, "BROADCAST_ROWS", 10)
    deps, ranges = tables(spark, 120, 60)
    counted = join_advisory(deps, ranges).groupBy("version", "id").agg(F.count("*").alias("n"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
