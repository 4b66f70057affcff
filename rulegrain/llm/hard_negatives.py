"""Hard negatives by an inverted multi-index with certified stops.

**Index.** A vector is cut into two halves, and each half has a codebook of its own, fitted on a bounded
sample. The pair of nearest codewords is a vector's cell. Every row is in the index; a codeword keeps
the radius of all halves assigned to it. For an anchor q no vector of cell (i, j) scores more than

    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j],

nor less than the same with the radii taken off.

**Search.** The multi-sequence heap visits an anchor's cells in falling order of that sum, from two
sorted lists of half bounds. It runs four times:

1. for a first guess at the positives: until the visited cells hold ``SEED_ROWS`` rows,
2. for the positives: until the bound is below the worst of that guess,
3. and 4. the same for negatives, whose windows follow from the positives. Cells that lie above all
   windows as a whole, by their lower bound, are passed over.

So the second and the fourth visit end with a certificate: what was not visited can't be in the result.
No cell is capped. Where vectors have no clusters the bounds are far apart and most cells are visited.

**Layout.** Cells are dealt over shards of at most about ``SHARD_ROWS`` rows; larger cells are split by
id. A visit is one row for each (anchor, shard) that holds visited cells, so that the shuffle carries
visits, and a task scores blocks of anchors against one shard's rows as a matrix product. Shards are
repeated for every ``ANCHORS`` anchors, which bounds a task on both sides. Only the best few rows of a
shard leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import prepare_workers, quoted

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these shares of its positive's, in percent.
LOW, HIGH = 50, 95
#: Codewords of a half; rows that the codebooks are fitted on, at most, and how often they move.
CODES, SAMPLE_ROWS, MOVES = 32, 16_384, 12
SEED_ROWS = 2_048
SHARD_ROWS, ANCHORS = 8_192, 65_536
#: Anchors scored at a time.
_STEP = 256
_EXACT = float(2**53)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part, one row per id."""
    whole = F.transform(quoted(vector_col), lambda x: F.floor(x.cast("double") * 256))
    odd = F.exists(quoted(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & quoted(vector_col).isNotNull() & ~odd)
    rows = rows.select(quoted(id_col).cast("bigint").alias("vec_id"), quoted(label_col).cast("bigint").alias("label"), whole.alias("v"))
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return once.select("vec_id", "row.label", "row.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles; short ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: whole numbers of any size where doubles would round."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    return whole[0] @ whole[1].T


class Codebooks:
    """Codewords of both halves, with the radii of what is assigned to them."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.width = sample.shape[1]
        self.cut = (self.width + 1) // 2
        self.words = [_fitted(part, codes) for part in (sample[:, : self.cut], sample[:, self.cut :])]
        self.radii = [np.zeros(len(w)) for w in self.words]

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.cut], rows[:, self.cut :]

    def nearest(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the codeword of every row and its distance, a little more rather than less."""
        found = []
        for part, words in zip(self.halves(rows), self.words):
            code = np.argmin((words**2).sum(1) - 2 * part @ words.T, 1)
            found.append((code, np.sqrt(((part - words[code]) ** 2).sum(1)) * (1 + 1e-9)))
        return found

    @property
    def second(self) -> int:
        return len(self.words[1])

    def bounds(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half and (row, codeword) the middle and the reach of the half scores."""
        found = []
        for part, words, radii in zip(self.halves(rows), self.words, self.radii):
            norm = np.sqrt((part**2).sum(1))[:, None]
            slack = 1e-9 * norm * np.sqrt((words**2).sum(1))[None, :] + 1e-6
            found.append((part @ words.T, norm * radii[None, :] * (1 + 1e-9) + slack))
        return found


def _fitted(rows: np.ndarray, codes: int) -> np.ndarray:
    """Codewords by a few moves of k-means from evenly spread rows."""
    if not len(rows) or not rows.shape[1]:
        return np.zeros((1, rows.shape[1]))
    distinct = np.unique(rows, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].astype(np.float64)
    for _ in range(MOVES):
        near = np.argmin((words**2).sum(1) - 2 * rows @ words.T, 1)
        held = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, rows)
        words[held > 0] = sums[held > 0] / held[held > 0, None]
    return words


def visits(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, float, int, int]]:
    """An anchor's cells in falling order of their upper bound, by the multi-sequence heap.

    ``first`` and ``second`` hold the middle and the reach of each half's scores. Yields the upper and
    the lower bound of a cell, and its codewords.
    """
    tops = [m + r for m, r in (first, second)]
    order = [np.argsort(-t, kind="stable") for t in tops]
    (a, b), (x, y) = [t[o].tolist() for t, o in zip(tops, order)], [(m - r)[o].tolist() for (m, r), o in zip((first, second), order)]
    i_of, j_of = order[0].tolist(), order[1].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, x[i] + y[j], i_of[i], j_of[j]
        # (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0): each cell enters the heap once
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Index:
    """Vectors by shard and cell, and what is needed to tell which shards an anchor has to visit."""

    def __init__(self, vectors: DataFrame, codes: int = CODES, shard_rows: int = SHARD_ROWS) -> None:
        """``vectors`` (vec_id, label, v) is a stored table of at least one row."""
        spark = vectors.sparkSession
        rows, self.width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        self.width = max(1, self.width)
        # a sample by the ids' hashes; its limit is a parameter, and it decides how much is visited, not what is found
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_ROWS / max(1, rows)))
        sample = _matrix(vectors.where(share).orderBy("vec_id").limit(2 * SAMPLE_ROWS).select("v").toArrow().column("v"), self.width)
        books = Codebooks(sample, codes)
        width = self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (i, far), (j, far2) = books.nearest(_matrix(batch.column("v"), width))
                cell = pa.array(i * books.second + j, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(far), pa.array(far2)], [*batch.schema.names, "cell", "far1", "far2"])

        assigned = stored(vectors.mapInArrow(assign, "vec_id long, label long, v array<bigint>, cell int, far1 double, far2 double"))
        cells = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("r1"), F.max("far2").alias("r2"))
        counts = np.zeros(len(books.words[0]) * books.second, np.int64)
        for cell, n, r1, r2 in cells.collect():  # one row per cell, codes * codes at most
            counts[cell] = n
            for half, code, r in ((0, cell // books.second, r1), (1, cell % books.second, r2)):
                books.radii[half][code] = max(books.radii[half][code], r)
        self.books, self.counts = books, counts
        # cells in order fill shards; a cell that is larger than a shard has several of its own
        self.first, self.parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        shard, held = 0, 0
        for cell, n in enumerate(counts.tolist()):
            if held and held + n > shard_rows:
                shard, held = shard + 1, 0
            self.first[cell], self.parts[cell] = shard, max(1, -(-n // shard_rows))
            if self.parts[cell] > 1:
                shard, held = shard + int(self.parts[cell]), 0
            else:
                held += n
        facts = spark.createDataFrame(pa.table({"cell": pa.array(range(len(counts)), pa.int32()), "first": self.first, "parts": self.parts}))
        own = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        dealt = assigned.drop("far1", "far2").join(F.broadcast(facts), "cell")  # codes * codes rows
        self.rows = stored(dealt.select("vec_id", "label", "v", "cell", own.cast("int").alias("shard")))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}


_VISIT = "shard int, part int, anchor long, label long, v array<bigint>, lows array<bigint>, highs array<bigint>, floor long, cells array<int>"


def _visited(index: Index, rows: int | None):
    """Visits of anchors: cells down to the anchor's floor, or only the first that hold ``rows`` rows.

    A null floor certifies nothing, so that all cells are visited.
    """

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                yield chosen(whole.slice(at, 512))

    def chosen(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second = index.books.bounds(_matrix(batch.column("v"), index.width))
        floors, highs = batch.column("floor").to_pylist(), batch.column("highs").to_pylist()
        owner, shards, cells = [], [], []
        for k in range(batch.num_rows):
            floor = -np.inf if floors[k] is None else floors[k]
            top = max(highs[k]) if highs[k] else np.inf
            of_shard: dict[int, list[int]] = {}
            seen = 0
            for upper, lower, i, j in visits((first[0][k], first[1][k]), (second[0][k], second[1][k])):
                if upper < floor or rows is not None and seen >= rows:
                    break
                cell = i * index.books.second + j
                if not index.counts[cell] or lower > top:
                    continue
                seen += int(index.counts[cell])
                for shard in range(int(index.first[cell]), int(index.first[cell] + index.parts[cell])):
                    of_shard.setdefault(shard, []).append(cell)
            owner += [k] * len(of_shard)
            shards += of_shard.keys()
            cells += of_shard.values()
        taken = batch.take(pa.array(owner, pa.int64()))
        arrays = [pa.array(shards, pa.int32()), *taken.columns, pa.array(cells, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, ["shard", *taken.schema.names, "cells"])

    return requests


def _scored(negatives: bool, width: int):
    """Best rows of a shard for each visit: (anchor, slot, vec_id, score). Of a shard's rows, those without an anchor sort first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "part")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                some = batch.slice(start, end - start)
                if tuple(keys[start]) != key:
                    key, parts, shard = tuple(keys[start]), [], None
                rows = some.filter(pa.compute.is_null(some.column("anchor")))
                if rows.num_rows:
                    parts.append(rows)
                asking = some.filter(pa.compute.is_valid(some.column("anchor")))
                if not asking.num_rows or not parts:
                    continue
                shard = shard or _Shard(parts, width)
                for at in range(0, asking.num_rows, _STEP):
                    yield shard.best(asking.slice(at, _STEP), negatives)

    return run


class _Shard:
    def __init__(self, parts: list[pa.RecordBatch], width: int) -> None:
        table = pa.Table.from_batches(parts)
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
        self.ids, self.width = ids[order], width
        self.labels, self.cells = (table.column(c).to_numpy()[order] for c in ("label", "cell"))
        self.rows = _matrix(table.column("v"), width)[order]

    def best(self, asking: pa.RecordBatch, negatives: bool) -> pa.RecordBatch:
        wanted = np.unique(asking.column("cells").flatten().to_numpy())
        some = np.flatnonzero(np.isin(self.cells, wanted))
        scores = _products(_matrix(asking.column("v"), self.width), self.rows[some])
        labels, ids = self.labels[some], self.ids[some]
        anchors, own = asking.column("anchor").to_numpy(), asking.column("label").to_numpy()
        lows, highs, floors = (asking.column(c).to_pylist() for c in ("lows", "highs", "floor"))
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for k, row in enumerate(scores):
            fits = (labels != own[k]) if negatives else (labels == own[k]) & (ids != anchors[k])
            windows = list(zip(lows[k], highs[k])) if negatives else [(None, None)]
            if floors[k] is not None:
                fits &= row >= floors[k]
            if negatives and windows:
                fits &= row <= max(highs[k])
            found = np.flatnonzero(fits)
            order = found[_falling(row[found], POSITIVES if not negatives else None)]
            falling = -row[order]
            for slot, (low, high) in enumerate(windows):
                start = 0 if high is None else int(np.searchsorted(falling, -high))
                end = len(order) if low is None else int(np.searchsorted(falling, -low, "right"))
                taken = order[start : min(end, start + (NEGATIVES if negatives else POSITIVES))]
                if len(taken):
                    out.append((int(anchors[k]), slot, ids[taken], row[taken]))
        sizes = [len(o[2]) for o in out]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([o[0] for o in out], sizes).astype(np.int64) if out else [], pa.int64()),
                pa.array(np.repeat([o[1] for o in out], sizes).astype(np.int32) if out else [], pa.int32()),
                pa.array(np.concatenate([o[2] for o in out]) if out else [], pa.int64()),
                pa.array([int(x) for o in out for x in o[3]], pa.int64()),
            ],
            ["anchor", "slot", "vec_id", "score"],
        )


def _falling(scores: np.ndarray, count: int | None) -> np.ndarray:
    """Order of falling scores, equal ones as they stand; with ``count`` only that many."""
    if count is None or len(scores) <= 4 * count or scores.dtype == object:
        return np.argsort(-scores, kind="stable")[: count or len(scores)]
    least = np.partition(scores, len(scores) - count)[len(scores) - count]
    near = np.flatnonzero(scores >= least)
    return near[np.argsort(-scores[near], kind="stable")][:count]


def _search(index: Index, anchors: DataFrame, negatives: bool, rows: int | None = None) -> DataFrame:
    """(anchor, slot, vec_id, score) of the best rows of each visited shard."""
    parts = max(1, -(-anchors.count() // ANCHORS))
    asked = anchors.select(F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int").alias("part"), "*").mapInArrow(_visited(index, rows), _VISIT)
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    copies = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = copies.select(
        "shard", "part", null("long", "anchor"), "label", "v", null("array<bigint>", "lows"), null("array<bigint>", "highs"),
        null("long", "floor"), null("array<int>", "cells"), "vec_id", "cell",
    )
    asked = asked.select("*", null("long", "vec_id"), null("int", "cell"))
    met = held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("anchor").asc_nulls_first())
    return met.mapInArrow(_scored(negatives, index.width), "anchor long, slot int, vec_id long, score long")


def _first(found: DataFrame, count: int) -> DataFrame:
    """anchor, slot, best: the first rows of each slot by falling score, then id."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "score")))
    return found.groupBy("anchor", "slot").agg(F.slice(ranked, 1, count).alias("best"))


def _kth(best: Column, count: int) -> Column:
    """Score of the last of ``count`` rows; null where there are fewer."""
    return F.when(F.size(best) >= count, F.element_at(best, count).getField("score"))


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    codes: int = CODES, shard_rows: int = SHARD_ROWS, seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors`` names.

    ``anchors`` is a condition on ``vec_id``. Defined results: rows without id, label or vector, or with
    a component that is null or not finite, take no part. Of rows that share an id the one with the
    smallest label, then vector, is used. Vectors of unequal length are compared as if the shorter one
    ended in zeros; an empty one scores zero with all. Anchors without another row of their label, and
    positives without a row in their window, give no rows, and neither does an empty table. Other
    columns are not read. Scores beyond 64 bits end the job with an error.
    """
    prepare_workers(vectors.sparkSession)
    rows = stored(usable(vectors, id_col, vector_col, label_col))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    index = Index(rows, codes, shard_rows)
    none = F.array().cast("array<bigint>")
    asked = stored(rows.where(anchors).select(
        F.col("vec_id").alias("anchor"), "label", "v", none.alias("lows"), none.alias("highs"), F.lit(None).cast("long").alias("floor")
    ))
    # what the first visit finds bounds the second one; anchors that found too little visit all cells
    guess = _first(_search(index, asked, False, seed_rows), POSITIVES).select("anchor", _kth(F.col("best"), POSITIVES).alias("floor"))
    bounded = stored(asked.drop("floor").join(guess, "anchor", "left").select(*asked.columns))
    positives = _first(_search(index, bounded, False), POSITIVES).select("anchor", F.posexplode("best").alias("slot", "p"))
    positives = stored(positives.select(
        "anchor", "slot", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"),
        _ceil(F.col("p.score") * LOW).alias("low"), _floor(F.col("p.score") * HIGH).alias("high"),
    ))
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))
    windows = windows.select("anchor", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.array_min("w.low").alias("floor"))
    mined = stored(asked.select("anchor", "label", "v").join(windows, "anchor").select(*asked.columns))
    guess = _first(_search(index, mined, True, seed_rows), NEGATIVES)
    guess = guess.select("anchor", F.struct("slot", _kth(F.col("best"), NEGATIVES).alias("kth")).alias("s"))
    guess = guess.groupBy("anchor").agg(F.map_from_entries(F.collect_list("s")).alias("kths"))
    # a window with enough negatives ends at the worst of them, any other at its own end
    ends = F.transform("lows", lambda low, slot: F.coalesce(F.try_element_at(F.col("kths"), slot), low))
    bounded = mined.drop("floor").join(guess, "anchor", "left").withColumn("floor", F.array_min(ends)).select(*mined.columns)
    negatives = _first(_search(index, stored(bounded), True), NEGATIVES).select("anchor", "slot", F.posexplode("best").alias("at", "n"))
    found = positives.join(negatives, ["anchor", "slot"])
    return found.select(
        F.col("anchor").alias("anchor_id"), "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"),
    )


def _floor(hundredfold: Column) -> Column:
    """A hundredth of whole numbers, rounded down, in whole numbers."""
    return F.call_function("div", hundredfold - F.pmod(hundredfold, F.lit(100)), F.lit(100).cast("long"))


def _ceil(hundredfold: Column) -> Column:
    return -_floor(-hundredfold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
