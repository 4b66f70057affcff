"""Connected components of a table of links: stars of parts of it, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import stored
from .common import from_scratch, prepare_workers

#: About how many links one task ties together before the rounds begin.
PART_LINKS = 250_000


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("hi", "lo") % 1_000_003)
    return tuple(edges.agg(F.count("*"), mark).first())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one part as stars: each of its nodes with the smallest one that these links reach."""
    held = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    nodes, place = np.unique(np.concatenate([x for side in zip(*held) for x in side]), return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    for at in range(0, len(tied), 50_000):
        some = tied[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["hi", "lo"])


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (a, b, both bigint) that is not the smallest of its component.

    First the links are tied in parts of about PART_LINKS, each in one task; few links are one part, and
    that is all. Else rounds follow. Each round ties the larger neighbours of a node to its smallest one, then the smaller ones, and is
    written to the shared folder, which cuts the plan. The smallest neighbour is an aggregate, so a node
    with very many links sends one row per task. Links to itself, null ends and repeated links do not
    count; no links give no rows.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a IS NOT NULL AND b IS NOT NULL AND hi > lo")
        .distinct()
    )
    prepare_workers(edges.sparkSession)
    parts = -(-edges.count() // PART_LINKS)
    if not parts:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    edges = stored(edges.coalesce(parts).mapInArrow(from_scratch(_stars), "hi bigint, lo bigint"))
    if parts == 1:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(smallest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(smallest.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
