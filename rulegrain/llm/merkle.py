"""Merkle manifest of a dataset, by time-forward processing.

Every row is a leaf, the leaves of a source form a 16-ary tree in order of their ids, and the roots of
these trees form one more tree in order of their sources. A node is labelled (tree, level, index).

**Up.** Digests travel forward to their parents through a priority queue ordered by label. Its far part
is a shuffle: the nodes of a tree are dealt in blocks of 16^3 neighbours, sorted by label. Its near part
is a heap inside the task, which delivers the digests of a block's nodes to their parents until the
block has become one node, three levels up. That node is the next round's leaf, so N leaves take
log(N) / log(4096) rounds. A block is 4096 rows whatever the size of its source.

**Down.** The reversed sweep starts at the root. A round's blocks meet the proof suffix that the round
above made for the block's node, the heap of the block runs again, and labels in falling order deliver
suffixes to children. Only blocks receive suffixes through the shuffle; those of single leaves exist
inside the task alone.

Positions come from one range-partitioned sort and prefix sums over its partitions, so that the rows of
a source are never in one task because they share a source.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import stored
from .common import crc_of_id, prepare_workers, quoted

FAN = 16
#: Levels that one round climbs: a block, which a task holds at a time, has FAN**CLIMB nodes.
CLIMB = 3


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def framed(column: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; null as a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.encode(F.concat(*[framed(f) for f in fields]), "utf-8"), 256)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows that are in order of ``keys`` as one table per key; a key has at most a block's rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end == start:
                continue
            now = tuple(c[start] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _levels(total: int, climb: int) -> int:
    """How many of the next levels a tree with ``total`` nodes on this one still has."""
    levels = 0
    while total > 1 and levels < climb:
        total, levels = -(-total // FAN), levels + 1
    return levels


def _swept(digests: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """Children's digests of each node (level, index) of a block, by a heap ordered by label."""
    queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)] if levels else []
    nodes: dict[tuple[int, int], list[str]] = {}
    while queue:  # already a heap: messages to one level are in order of their labels
        level, index = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        nodes[level, index] = children
        if level < levels:
            heapq.heappush(queue, (level + 1, index // FAN, index, _hash(children)))
    return nodes


def _up(climb: int):
    """One row per block: the node that it becomes."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for block in _runs(batches, "tree", "block"):
            total, digests = block.column("total")[0].as_py(), block.column("digest").to_pylist()
            levels = _levels(total, climb)
            nodes = _swept(digests, levels)
            top = _hash(nodes[levels, 0]) if levels else digests[0]
            found.append((block.column("tree")[0].as_py(), block.column("block")[0].as_py(), -(-total // FAN**levels), top))
            if len(found) >= 10_000:
                yield _up_rows(found)
                found = []
        if found:
            yield _up_rows(found)

    return swept


def _up_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found))
    arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["tree", "place", "total", "digest"])


def _down(folds: bool, climb: int):
    """A block's rows, after the suffix of its node, as proofs of its rows.

    A proof is the siblings before and after the node on each level, lowest first. ``folds`` marks the
    last sweep, which gives each leaf the digest of its proof and the root that its other digest leads
    to; earlier ones give the proof itself, as the suffix of the block below. The suffix also brings
    the tree's own root (digest) and the whole one (other).
    """

    def proofs(block: pa.Table) -> tuple[list[str], list[str], list[tuple[list[str], list[str]]]]:
        rows = block.slice(1)  # the suffix sorts first
        digests, levels = rows.column("digest").to_pylist(), _levels(rows.column("total")[0].as_py(), climb)
        # labels in falling order: each node hands its suffix, with the siblings of the child before it, to its children
        suffix = {(levels, 0): (block.column("before")[0].as_py(), block.column("after")[0].as_py())}
        for (level, index), children in reversed(_swept(digests, levels).items()):
            left, right = suffix.pop((level, index))
            for i in range(len(children)):
                handed = (["".join(children[:i]), *left], ["".join(children[i + 1 :]), *right])
                suffix[level - 1, index * FAN + i] = handed
        return digests, rows.column("other").to_pylist(), [suffix[0, i] for i in range(len(digests))]

    def folded(block: pa.Table) -> pa.RecordBatch:
        digests, others, found = proofs(block)
        ends, sums = [], []
        for node, (left, right) in zip(others, found):
            for x, y in zip(left, right):
                node = _hash([x, node, y])
            ends.append(node)
            sums.append(_hash([z for pair in zip(left, right) for z in pair]))
        n = len(digests)
        same = [pa.array([block.column(c)[0].as_py()] * n, pa.string()) for c in ("digest", "other")]
        tag = block.column("tag").combine_chunks().slice(1)
        return pa.RecordBatch.from_arrays([tag, pa.array(digests), *same, pa.array(sums), pa.array(ends)], FOLDED)

    def handed(block: pa.Table) -> pa.RecordBatch:
        digests, _, found = proofs(block)
        n, lists = len(digests), pa.list_(pa.string())
        arrays = [pa.array([block.column("tree")[0].as_py()] * n, pa.int64()), block.column("place").combine_chunks().slice(1)]
        arrays += [pa.array([p[side] for p in found], lists) for side in (0, 1)]
        arrays += [pa.array([block.column(c)[0].as_py()] * n, pa.string()) for c in ("digest", "other")]
        return pa.RecordBatch.from_arrays(arrays, ["tree", "place", "before", "after", "digest", "other"])

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, "tree", "block"):
            yield folded(block) if folds else handed(block)

    return swept


FOLDED = ["tag", "leaf", "subroot", "root", "proof_sha256", "folded_root"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its place in its group (local) and its group's number (run), both within this partition; rows are in order."""
    last, held, run = None, 0, -1
    for batch in batches:
        groups = batch.column("grp")
        codes = pa.compute.fill_null(groups.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new = np.concatenate([[(groups[0].as_py(),) != last], codes[1:] != codes[:-1]])
        starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
        lengths = np.diff(starts, append=len(codes))
        local = np.arange(len(codes)) - np.repeat(starts, lengths)
        if not new[0]:
            local[: lengths[0]] += held
        runs = run + np.cumsum(new)
        held, run, last = int(local[-1]) + 1, int(runs[-1]), (groups[-1].as_py(),)
        yield batch.append_column("local", pa.array(local, pa.int64())).append_column("run", pa.array(runs, pa.int64()))


def places(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with tree (a number of the group), place (from 0 in the group's order) and total (the group's rows).

    The sort is spread over range partitions by group and order; what each partition holds of a group is
    added up over the partitions. Null is a group, before all others.
    """
    prepare_workers(rows.sparkSession)
    named = rows.withColumn("grp", quoted(group))
    keys = [F.col("grp").asc_nulls_first(), *[quoted(o).asc_nulls_first() for o in order]]
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{n}` {t}" for n, t in [*ordered.dtypes, ("local", "bigint"), ("run", "bigint")])
    sorted_rows = stored(ordered.mapInArrow(_numbered, schema))
    held = sorted_rows.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("run").alias("run"))
    # one row per group and partition: a group has at most as many rows here as there are partitions
    of_group = Window.partitionBy("grp")
    offsets = held.select(
        F.col("grp").alias("o_grp"), F.col("part").alias("o_part"),
        (F.sum("n").over(of_group.orderBy("part")) - F.col("n")).alias("offset"),
        F.sum("n").over(of_group).alias("total"),
        F.min(F.shiftleft(F.col("part").cast("long"), 40) + F.col("run")).over(of_group).alias("tree"),
    )
    met = sorted_rows.join(offsets, F.col("grp").eqNullSafe(F.col("o_grp")) & (F.col("part") == F.col("o_part")))
    return met.withColumn("place", F.col("local") + F.col("offset")).drop("grp", "part", "local", "run", "o_grp", "o_part", "offset")


def _blocked(nodes: DataFrame, climb: int, *more: str | Column) -> DataFrame:
    return nodes.select("tree", F.floor(F.col("place") / FAN**climb).cast("long").alias("block"), "place", "total", *more)


def _climb(leaves: DataFrame, climb: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round starts from, and (tree, digest) of the roots."""
    rounds, roots, nodes = [], None, leaves
    while True:
        rounds.append(nodes)
        dealt = _blocked(nodes, climb, "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        made = stored(dealt.mapInArrow(_up(climb), "tree long, place long, total long, digest string"))
        done = made.where("total = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = made.where("total > 1")
        if nodes.isEmpty():
            return rounds, roots


def _descend(rounds: list[DataFrame], suffixes: DataFrame, folds: bool, climb: int) -> DataFrame:
    """The reversed sweep, from (tree, before, after, digest, other) of the roots down to the first round.

    With ``folds`` the columns FOLDED of every leaf, else tree, place, before, after, digest, other.
    """
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    suffixes = suffixes.select("tree", F.lit(0).cast("long").alias("block"), "before", "after", "digest", "other")
    tag = dict(rounds[0].dtypes)["tag"]
    for number in reversed(range(len(rounds))):
        last = number == 0
        kind = tag if last else "string"
        own = [F.col("other"), F.col("tag")] if last else [null("string", "other"), null("string", "tag")]
        lists = [null("array<string>", "before"), null("array<string>", "after")]
        members = _blocked(rounds[number], climb, "digest", *own, *lists)
        trees = rounds[number].select("tree").distinct()
        # trees that had their root in a round before this one have no node here and keep the suffix they have
        heads = suffixes if last else suffixes.join(trees, "tree", "left_semi")
        heads = heads.select(
            "tree", "block", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("total"),
            "digest", "other", null(kind, "tag"), "before", "after",
        )
        dealt = members.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        if last and folds:
            return dealt.mapInArrow(_down(True, climb), f"tag {tag}, " + ", ".join(f"{c} string" for c in FOLDED[1:]))
        lower = dealt.mapInArrow(_down(False, climb), "tree long, place long, before array<string>, after array<string>, digest string, other string")
        if last:
            return lower
        # a node of this round is a block of the round below
        ended = suffixes.join(trees, "tree", "left_anti")
        suffixes = stored(lower.withColumnRenamed("place", "block").unionByName(ended))
    raise AssertionError("a climb has a round at least")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    other: dict[str, Column] | None = None, climb: int = CLIMB,
) -> DataFrame:
    """Id, leaf, subroot, root, proof_sha256 and folded_root of every row.

    ``other`` replaces fields by other values (a changed copy of the data, say): the proof of the original
    row is folded with the digest of the changed one, and leads to the root only if nothing has changed.

    Defined results: null differs from an empty value in every field, and a null source is a source
    before all others. Rows without id come first in their source; rows with equal ids are ordered by
    their digests, and equal rows are leaves of their own. A lone row is its own subroot and proves it
    with an empty proof. A table without rows has no root and gives no rows. Columns that are no field
    are not read. ``climb`` is the number of levels that a round climbs.
    """
    prepare_workers(docs.sparkSession)
    changed = other or {}
    leaf = leaf_digest(*[quoted(f) for f in fields])
    rows = stored(docs.select(
        quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"), leaf.alias("digest"),
        (leaf_digest(*[changed.get(f, quoted(f)) for f in fields]) if changed else leaf).alias("other"),
    ))
    placed = stored(places(rows, "source", "doc_id", "digest"))
    rounds, subroots = _climb(placed.withColumnRenamed("doc_id", "tag"), climb)
    named = subroots.join(placed.where("place = 0").select("tree", "source"), "tree").withColumnRenamed("tree", "tag")
    upper = stored(places(named.withColumn("all", F.lit("")).withColumn("other", F.col("digest")), "all", "source"))
    above, root = _climb(upper, climb)
    empty = F.array().cast("array<string>")
    start = root.select("tree", empty.alias("before"), empty.alias("after"), "digest", F.col("digest").alias("other"))
    of_sources = _descend(above, start, folds=False, climb=climb).withColumnRenamed("other", "whole").drop("digest")
    facts = upper.select("tree", "place", "tag", "digest")
    tops = of_sources.join(facts, ["tree", "place"])
    tops = stored(tops.select(F.col("tag").alias("tree"), "before", "after", "digest", F.col("whole").alias("other")))
    return _descend(rounds, tops, folds=True, climb=climb).withColumnRenamed("tag", "doc_id")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame, climb: int = CLIMB) -> DataFrame:
    """The manifest of ``docs``, folded with texts in lower case where 5 divides the CRC-32 of the id."""
    hit = F.col("doc_id").isNotNull() & (F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0)
    found = manifest(docs, other={"text": F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))}, climb=climb)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))


def _oracle(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves a source and as many sources, level by level."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),"
        " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),"
        " lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"
    )
    frame = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = " || ".join(frame(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {low} ELSE text END"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, source, sha256({fields} || {frame('text')}) AS leaf, sha256({fields} || {frame('tampered')}) AS other"
        f" FROM (SELECT *, {text} AS tampered FROM documents))",
        "p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
    ]

    def tree(name: str, group: str, rows: str) -> str:
        """Steps that climb from rows (group, i, digest); each level has its runs as lists."""
        steps.append(f"{name}0 AS (SELECT {group} AS g, i, digest, count(*) OVER (PARTITION BY {group}) AS n FROM {rows})")
        for k in range(levels):
            steps.append(
                f"{name}r{k} AS MATERIALIZED (SELECT g, i // 16 AS i, list(digest ORDER BY i) AS l, any_value(n) AS n FROM {name}{k} GROUP BY g, i // 16)"
            )
            steps.append(
                f"{name}{k + 1} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(array_to_string(l, '')) ELSE l[1] END AS digest, (n + 15) // 16 AS n FROM {name}r{k})"
            )
        return f"{name}{levels}"

    def fold(name: str, table: str, start: str) -> str:
        """Steps that carry each row of ``start`` (g, pos, folded, proof, ...) up the tree."""
        for k in range(levels):
            before, after = "array_to_string(l[1:pos % 16], '')", "array_to_string(l[pos % 16 + 2:], '')"
            steps.append(
                f"{name}{k + 1} AS (SELECT s.* EXCLUDE (pos, folded, proof), pos // 16 AS pos,"
                f" CASE WHEN r.n > 1 THEN sha256({before} || folded || {after}) ELSE folded END AS folded,"
                f" CASE WHEN r.n > 1 THEN proof || {before} || {after} ELSE proof END AS proof"
                f" FROM {start if k == 0 else f'{name}{k}'} s JOIN {table}r{k} r ON s.g IS NOT DISTINCT FROM r.g AND s.pos // 16 = r.i)"
            )
        return f"{name}{levels}"

    top = tree("t", "source", "(SELECT source, i, leaf AS digest FROM p)")
    steps.append(f"s AS MATERIALIZED (SELECT g AS source, digest, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM {top})")
    root = tree("u", "0", "s")
    folded = fold("f", "t", "(SELECT source AS g, i AS pos, other AS folded, '' AS proof, doc_id, leaf, source FROM p)")
    steps.append(
        f"m AS (SELECT 0 AS g, s.i AS pos, f.folded, f.proof, f.doc_id, f.leaf, s.digest AS subroot FROM {folded} f JOIN s ON f.source IS NOT DISTINCT FROM s.source)"
    )
    ended = fold("h", "u", "m")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,"
        f" folded = r.digest AS verified FROM {ended} JOIN {root} r ON true"
    )


ORACLE = _oracle()
