"""Version ranges as an interval index: each dependency meets only the advisories that cover it.

A package may have hundreds of ranges and thousands of versions, so testing every pair is what to avoid.
Distinct versions of a package are ranked, by keys whose byte order is the order of versions, and a range
covers an interval of ranks. An interval is the union of a few aligned blocks of 1, 2, 4, ... ranks, and a
version lies in one block of each size, so that range and version meet in exactly one block, by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.versions import parse_version
from ..sources.tables import stored
from .joins import BROADCAST_ROWS, lookup_join, rows_at_most, salted_join

PACKAGE = ["ecosystem", "package"]
BLOCK = [*PACKAGE, "level", "block"]

#: Facts in their blocks, about a dozen short rows a fact, are broadcast up to this many rows.
INDEX_ROWS = 400_000
#: Rows of the result that one piece of the ranges may make.
PIECE_ROWS = 2_000_000


def version_order(key: Column) -> Column:
    """A parsed version as text whose byte order is that of versions; versions that are equal have one text.

    Trailing zeros go, as ``1.0`` is ``1``; each number is led by how many digits it has.
    """
    some = lambda n: (n["size"] > 1) | (n["digits"] != "0")
    last = F.array_max(F.transform(key, lambda n, i: F.when(some(n), i + 1).otherwise(0)))
    parts = F.transform(F.slice(key, F.lit(1), F.coalesce(last, F.lit(0))), lambda n: F.concat(F.lpad(n["size"].cast("string"), 10, "0"), n["digits"]))
    return F.when(key.isNotNull(), F.array_join(parts, ""))


def _blocks(low: Column, high: Column) -> Column:
    """The aligned blocks (level, block) whose union is the interval [low, high) of ranks."""
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    block = lambda level, at: F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        odd_low = (low < high) & (low % 2 == 1)
        odd_high = (low < high) & (high % 2 == 1) & ((low + F.when(odd_low, 1).otherwise(0)) < high)
        taken = F.concat(
            state["taken"], F.when(odd_low, block(level, low)).otherwise(none), F.when(odd_high, block(level, high - 1)).otherwise(none)
        )
        return F.struct(
            F.shiftright(low + F.when(odd_low, F.lit(1)).otherwise(F.lit(0)).cast("long"), 1).alias("low"),
            F.shiftright(high, 1).alias("high"), taken.alias("taken"),
        )

    start = F.struct(low.alias("low"), high.alias("high"), none.alias("taken"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, step)["taken"]


def _index(versions: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of each distinct version (package, place, level, block) and those of each range (package, level, block, ...).

    ``versions`` and ``ranges`` hold the texts of version_order as ``place`` and ``bound``, none of them null.
    """
    versions = versions.select(*PACKAGE, "place").distinct()
    marks = versions.select(*PACKAGE, "place", F.lit(1).alias("held")).unionByName(
        ranges.select(*PACKAGE, F.col("bound").alias("place"), F.lit(0).alias("held")).distinct()
    )
    of_package = Window.partitionBy(*PACKAGE)
    placed = marks.select(
        *PACKAGE, "place", "held",
        F.sum("held").over(of_package.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.sum("held").over(Window.partitionBy(*PACKAGE, "place")).alias("here"),
        F.sum("held").over(of_package).alias("total"),
    )
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest("total", F.lit(1)))).cast("int") + 1)
    ranks = placed.where("held = 1").select(*PACKAGE, "place", (F.col("upto") - 1).alias("rank"), F.explode(levels).alias("level"))
    ranks = ranks.select(*PACKAGE, "place", "level", F.expr("shiftright(rank, level)").alias("block"))
    ends = placed.where("held = 0").select(*PACKAGE, F.col("place").alias("bound"), (F.col("upto") - F.col("here")).alias("below"), "upto", "total")
    met = ranges.join(ends, [*PACKAGE, "bound"])
    zero, op = F.lit(0).cast("long"), F.col("op")
    low = F.when(op.isin("<", "<="), zero).when(op == ">", F.col("upto")).when(op.isin(">=", "=="), F.col("below"))
    high = F.when(op == "<", F.col("below")).when(op.isin("<=", "=="), F.col("upto")).when(op.isin(">", ">="), F.col("total"))
    cut = met.withColumn("low", low).withColumn("high", high).where("low < high")
    cut = cut.withColumn("b", F.explode(_blocks(F.col("low"), F.col("high")))).withColumns({"level": F.col("b.level"), "block": F.col("b.block")})
    kept = [c for c in ranges.columns if c not in (*PACKAGE, "bound")]
    return ranks, cut.select(*PACKAGE, "level", "block", *kept)


def _placed(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.withColumn(name, version_order(F.col(key))).where(F.col(name).isNotNull())


def covering(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each version (ecosystem, package, version_key) with every range (ecosystem, package, op, bound_key, ...) that covers it.

    Gives the package, ``place`` (the version's text of version_order) and the other columns of the
    ranges, one row per distinct version and covering range: the join makes no row that is no result.
    Ranges with an unknown comparator or a null bound cover nothing.
    """
    ranks, cut = _index(_placed(versions, "version_key", "place"), _placed(ranges, "bound_key", "bound"))
    kept = [c for c in cut.columns if c not in BLOCK]
    return cut.join(ranks, BLOCK).select(*PACKAGE, "place", *kept)


def join_ranges(facts: DataFrame, ranges: DataFrame, spread: list[Column], near: list[str]) -> DataFrame:
    """``facts`` (ecosystem, package, version, ...) with the columns of every range that covers their version.

    Each distinct version text is parsed once. While versions have few covering ranges in all, these are
    found once per version and broadcast: one version may be that of a third of all facts. Beyond that the
    result is too large to be made twice, so facts and ranges meet by their blocks. The rows to come are
    counted from the blocks first. Few facts go to all ranges, which are dealt by ``near`` (columns of
    theirs) into pieces of a bounded result; else the smaller side is repeated over salts of the larger
    one, dealt by ``spread`` or ``near``.
    """
    keys = [*PACKAGE, "version"]
    texts = facts.select(*keys).distinct().where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    texts = stored(_placed(texts.withColumn("version_key", parse_version(F.col("version"))), "version_key", "place").drop("version_key"))
    bounds = _placed(ranges, "bound_key", "bound")
    ranks, cut = _index(texts, bounds)
    kept = [c for c in cut.columns if c not in BLOCK]
    found = texts.join(cut.join(ranks, BLOCK).select(*PACKAGE, "place", *kept), [*PACKAGE, "place"]).drop("place")
    if rows_at_most(found, BROADCAST_ROWS):
        return lookup_join(facts, found, keys, "inner", spread, rows=0)
    cut = stored(cut)
    blocks = F.sort_array(F.collect_list(F.struct("level", "block")))
    of_version = ranks.groupBy(*PACKAGE, "place").agg(blocks.alias("blocks"))
    of_text = texts.join(of_version, [*PACKAGE, "place"]).select(*keys, "blocks")
    in_blocks = stored(lookup_join(facts, of_text, keys, "inner", spread).select("*", F.inline("blocks")).drop("blocks"))
    n_cut, n_facts = cut.count(), in_blocks.count()
    shown = [F.col(f"f.`{c}`") for c in facts.columns] + [F.col(f"l.`{c}`") for c in kept]
    if n_facts <= INDEX_ROWS:
        pairs = cut.groupBy(*BLOCK).agg(F.count("*").alias("n")).join(in_blocks.groupBy(*BLOCK).agg(F.count("*").alias("m")), BLOCK)
        rows = pairs.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        session = cut.sparkSession
        pieces = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism, -(-rows // PIECE_ROWS))
        dealt = cut.repartition(pieces, *near)
        on = [F.col(f"f.{c}") == F.col(f"l.{c}") for c in BLOCK]
        return dealt.alias("l").join(F.broadcast(in_blocks).alias("f"), on).select(*shown)
    if n_cut <= n_facts:
        joined = salted_join(in_blocks, cut, BLOCK, "inner", spread)
    else:
        joined = salted_join(cut, in_blocks, BLOCK, "inner", [F.col(c) for c in near])
    return joined.select(*facts.columns, *kept)
