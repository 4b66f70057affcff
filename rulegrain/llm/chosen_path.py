"""Near-copies by a chosen-path set similarity join.

Documents are sets of word shingles; two are linked when their intersection is at least 85 % of their
union. Equal sets are one class from the start, and classes are what is joined.

**Branching.** A minwise token of a set is its least shingle under a hash function, and two sets share
one with the probability of their similarity. A tree starts with a token of its own at the root, and a
node of it holds the sets that agree on the tokens chosen on the way. A node that is small is compared
exhaustively. A larger one chooses ``BRANCH`` further tokens by the hash of its path, and each set goes
to the child of its token for each of them. Sets that differ part soon; a linked pair stays together in
some leaf of a tree with a probability p that ``survival`` gives, and independent trees are repeated
until the expected recall of a pair reaches ``RECALL``.

**Small nodes.** Only sets of different components are of interest, so a node whose sets are in one
component is done, and a node is small if few of its sets are outside its largest component. Where
another branching would not lower the number of pairs to compare, the node is compared as it is.
Nodes of up to ``NODE`` sets branch inside a task. Larger ones never come together in one: their sets
are tied to a hub and move on to children each by itself, to be counted again in the next round.

**Comparison.** A sketch of 192 bytes stands for a set: parities of its shingles, whose distance is a
lower bound of the true one, and 128 minwise tokens of a byte each. What passes is confirmed on the full
sets: first each set's nearest partner, which ties large groups of near-copies together, and then all
pairs that are still in different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import Bitmap, prepare_workers, quoted, slices
from .components import components
from .jaccard_join import _mix as mix, _word_hashes as word_hashes

WORDS = 3
#: Least similarity in percent.
SIMILARITY = 85
#: Tokens that a node chooses, and the share of linked pairs that some leaf has to hold.
BRANCH, RECALL = 2, 0.9999
TOKENS, PARITIES = 128, 512
#: Sets outside a small node's largest component, and sets of a node that branches inside a task.
LEAF, NODE = 256, 8_192
#: Tokens of a linked pair that agree at least: 5 standard deviations below the mean.
AGREEING = int(TOKENS * SIMILARITY / 100 - 5 * math.sqrt(TOKENS * SIMILARITY / 100 * (1 - SIMILARITY / 100)))
_U = np.uint64
#: Fixed odd factors, one for each word of a shingle and for each hash function.
_FACTORS = mix(np.arange(1, 400, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def survival(similarity: float, branch: int = BRANCH) -> float:
    """Probability that a pair of this similarity shares a leaf of a tree, however deep it is."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - similarity + similarity * lost) ** branch
    return similarity * (1 - lost)


TREES = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(SIMILARITY / 100)))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; with fewer words, of the whole sequence."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not parts:
        return []
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts, words = word_hashes(np.frombuffer(b" ".join([*parts, b""]), np.uint8))
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    counts = np.diff(first, append=len(starts))
    rows = max(0, len(words) - WORDS + 1)
    joined = mix(sum((words[i : i + rows] * _FACTORS[i] for i in range(WORDS)), np.zeros(rows, np.uint64)))
    found = []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n >= WORDS:
            found.append(np.unique(joined[at : at + n - WORDS + 1]))
        else:
            whole = (words[at : at + n] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True)
            found.append(mix(whole + _FACTORS[WORDS : WORDS + 1] * _U(n)) if n else whole[:0])
    return found


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    parts = (mix(values ^ _FACTORS[10]).sum(), mix(values ^ _FACTORS[11]).sum())
    return tuple(int(p.view(np.int64)) for p in parts)


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketch (bytes: parities, then tokens) and the trees' root tokens of each set; sets are not empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    place = np.repeat(np.arange(len(sets)) * PARITIES, sizes) + (values >> _U(20) & _U(PARITIES - 1)).astype(np.int64)
    parities = np.packbits((np.bincount(place, minlength=PARITIES * len(sets)) & 1).astype(bool)).reshape(len(sets), -1)
    least = [np.minimum.reduceat(values * f, starts) for f in _FACTORS[20 : 20 + TREES + TOKENS]]
    roots = np.stack([mix(t + _FACTORS[i]) for i, t in enumerate(least[:TREES])], 1).view(np.int64)
    tokens = np.stack([mix(t).astype(np.uint8) for t in least[TREES:]], 1)
    return np.concatenate([parities, tokens], 1), roots


def _sets_of(batches: Iterator[pa.RecordBatch], size: int = 300_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", size):
        yield batch, shingle_sets(batch.column("text").to_pylist())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets_of(batches):
        full = [s for s in sets if len(s)]
        made, roots = sketches(full) if full else ([], [])
        each = iter(zip(made, roots))
        rows = [next(each) if len(s) else None for s in sets]
        keys = [set_key(s) if len(s) else (None, None) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int32()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)),
                pa.array([r and r[0].tobytes() for r in rows], pa.binary()), pa.array([r and r[1] for r in rows], pa.list_(pa.int64())),
            ],
            ["doc_id", "n", "node", "twin", "sketch", "roots"],
        )


class Sketches:
    """Sets of one node, side by side."""

    def __init__(self, table: pa.Table) -> None:
        width = PARITIES // 8 + TOKENS
        data = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, width)
        self.parities = np.ascontiguousarray(data[:, : PARITIES // 8]).view(np.uint64)
        self.tokens = data[:, PARITIES // 8 :]
        self.number, self.root, self.n = (table.column(c).to_numpy() for c in ("number", "root", "n"))

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in x and y of pairs of members of different components that may be linked, and their agreeing tokens."""
        apart = np.zeros((len(x), len(y)), np.uint16)
        for w in range(self.parities.shape[1]):
            apart += np.bitwise_count(self.parities[x, w][:, None] ^ self.parities[y, w][None, :])
        total = self.n[x][:, None] + self.n[y][None, :]
        # a linked pair differs in (100 - s) / (100 + s) of both sizes together
        fits = apart.astype(np.int64) * (100 + SIMILARITY) <= (100 - SIMILARITY) * total.astype(np.int64)
        fits &= self.root[x][:, None] != self.root[y][None, :]
        i, j = np.nonzero(fits)
        small, large = np.minimum(self.n[x[i]], self.n[y[j]]), np.maximum(self.n[x[i]], self.n[y[j]])
        sized = small.astype(np.int64) * 100 >= large.astype(np.int64) * SIMILARITY
        i, j = i[sized], j[sized]
        agreeing = np.zeros(len(i), np.int64)
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            agreeing[part] = (self.tokens[x[i[part]]] == self.tokens[y[j[part]]]).sum(1)
        kept = agreeing >= AGREEING
        return i[kept], j[kept], agreeing[kept]

    def pairs(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x), LEAF):
            i, j, _ = self.near(x[at : at + LEAF], y)
            yield self.number[x[at : at + LEAF][i]], self.number[y[j]]

    def nearest(self, all_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each member with the partner that seems nearest, of as many neighbours as a leaf holds, and with the node's first."""
        for at in range(0, len(all_), LEAF):
            some = all_[at : at + LEAF]
            i, j, agreeing = self.near(some, some)
            order = np.lexsort((self.number[some[j]], -agreeing, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            yield self.number[some[i[first]]], self.number[some[j[first]]]
            i, j, _ = self.near(some, all_[:1])
            yield self.number[some[i]], self.number[all_[:1][j]]


def _chosen(path: int) -> list[int]:
    """The tokens that a node chooses: distinct ones, by the hash of its path."""
    order = np.argsort(mix(_FACTORS[200 : 200 + TOKENS] + _U(path)), kind="stable")
    return order[:BRANCH].tolist()


def _child(path: int, token: int, values: np.ndarray) -> np.ndarray:
    """Hashes of the paths to a node's children."""
    return mix(np.array([path], np.uint64) * _FACTORS[12] + _FACTORS[200 + token] + values.astype(np.uint64) * _FACTORS[13])


def _branch(sets: Sketches, start: np.ndarray, path: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a node's sets in different components that may be linked."""
    stack = [(start, path)]
    while stack:
        node, path = stack.pop()
        labels, counts = np.unique(sets.root[node], return_counts=True)
        if len(labels) < 2:
            continue
        outside = node[sets.root[node] != labels[np.argmax(counts)]]
        children = []
        if len(outside) > LEAF:
            cost = 0
            for token in _chosen(path):
                values = sets.tokens[node, token]
                order = np.argsort(values, kind="stable")
                cuts = np.flatnonzero(np.diff(values[order].astype(np.int16))) + 1
                groups = np.split(node[order], cuts)
                cost += sum(len(g) ** 2 for g in groups)
                children += [(g, int(_child(path, token, sets.tokens[g[:1], token])[0])) for g in groups if len(g) > 1]
            if cost > 0.9 * len(node) ** 2:
                children = []
        if children:
            stack += children
        else:
            yield from sets.pairs(outside, node)


def _compare(nearest: bool):
    """Candidate pairs (a < b) of nodes; rows are in order of key."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sets = Sketches(pa.Table.from_batches(rows))
        everyone = np.arange(len(sets.number))
        parts = list(sets.nearest(everyone) if nearest else _branch(sets, everyone, rows[0].column("key")[0].as_py() % 2**64))
        a, b = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if held and held[0].column("key")[0].as_py() != keys[start]:
                    yield found(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield found(held)

    return compared


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of members of a node that no task holds as a whole: each member finds its own."""
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        keys, numbers = batch.column("key").to_numpy(), batch.column("number").to_numpy()
        for key in np.unique(keys).tolist():
            at = np.flatnonzero(keys == key)
            for token in _chosen(key % 2**64):
                child = _child(key % 2**64, token, sketch[at, PARITIES // 8 + token]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(numbers[at])], ["key", "number"])


def _round(rows: DataFrame, labels: DataFrame, classes: DataFrame, nearest: bool, node: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b) of the nodes of ``rows`` (key, number), and the rows of the next level, if any.

    Only keys and labels are shuffled to find the nodes that hold several components; sketches are
    fetched for the members of these.
    """
    tagged = rows.join(labels, "number")
    nodes = tagged.groupBy("key").agg(
        F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("number").alias("hub")
    )
    mixed = nodes.where("lo <> hi").select("key", "members", "hub")
    alive = stored(tagged.join(mixed, "key"))
    facts = classes.select("number", "n", "sketch")
    small = alive.where(F.col("members") <= node).select("key", "number", "root").join(facts, "number")
    dealt = small.repartition("key").sortWithinPartitions("key", "number")
    pairs = dealt.mapInArrow(_compare(nearest), "a bigint, b bigint")
    large = alive.where((F.col("members") > node) & (F.col("number") != F.col("hub")))
    hubs = large.select(F.col("hub").alias("a"), F.col("number").alias("b"))
    further = None
    if not nearest and not large.isEmpty():
        moved = alive.where(F.col("members") > node).select("key", "number").join(facts.select("number", "sketch"), "number")
        further = stored(moved.mapInArrow(_children, "key bigint, number bigint").distinct())
    return (pairs.unionByName(hubs) if nearest else pairs).distinct(), further


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for _, sets in _sets_of(batches):
        named = {key: s for key, s in ((set_key(s), s) for s in sets if len(s)) if key not in seen}
        seen.update(named)
        arrays = [*(pa.array([k[i] for k in named], pa.int64()) for i in (0, 1)), pa.array([s.view(np.int64) for s in named.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "twin", "shingles"])


def _confirmed(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b): the pairs whose full sets are similar enough."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number"))).distinct()
    needed = stored(classes.join(ends, "number", "left_semi").select("number", "rep", "node", "twin"))
    wanted = Bitmap(needed.select(F.xxhash64("rep")))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = wanted.may_hold(batch.column("place").to_numpy())
            if some.any():
                yield batch.select(["text"]).filter(pa.array(some))

    held = texts.select(F.xxhash64("doc_id").alias("place"), "text").mapInArrow(
        lambda batches: _emit_sets(chosen(batches)), "node bigint, twin bigint, shingles array<bigint>"
    )
    sets = held.join(needed, ["node", "twin"]).select("number", "shingles")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    links = shared.where(100 * F.col("shared") >= SIMILARITY * (F.col("total") - F.col("shared")))
    return stored(links.select("a", "b").distinct())


def _labels(classes: DataFrame, links: DataFrame | None) -> DataFrame:
    """number, root of every class; a class without links is its own root."""
    if links is None:
        return classes.select("number", F.col("number").alias("root"))
    found = components(links).toDF("number", "root")
    return stored(classes.select("number").join(found, "number", "left").select("number", F.coalesce("root", "number").alias("root")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node: int = NODE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept of every row.

    Every link reported was confirmed on the full sets. A link is missed with a probability below
    1 - RECALL, and matters only if no other links connect its documents.

    Defined results: a text without words, or a null one, has no shingles, is linked with nothing and
    kept; a text with fewer words than a shingle has one. Rows that repeat each have a row, in one
    component, and all of those with the smallest id are kept. Ids may be of any type that has an order;
    a null id is a component's id only where no other id is in it. An empty table has no rows. Other
    columns are not read. ``node`` is the size up to which a node is held by one task.
    """
    prepare_workers(docs.sparkSession)
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    members = stored(texts.mapInArrow(_members, f"doc_id {kind}, n int, node bigint, twin bigint, sketch binary, roots array<bigint>"))
    grouped = members.where("n > 0").groupBy("node", "twin").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("roots").alias("roots")
    )
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("number"), "*"))
    rows, links = classes.select(F.explode("roots").alias("key"), "number"), None
    labels = _labels(classes, None)
    while rows is not None:
        for nearest in (True, False):
            pairs, further = _round(rows, labels, classes, nearest, node)
            found = _confirmed(pairs, texts, classes)
            links = found if links is None else links.unionByName(found)
            labels = _labels(classes, links)
        rows = further
    named = classes.select("number", "node", "twin", "rep").join(labels, "number")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = members.select("doc_id", "n", "node", "twin").join(
        named.join(smallest, "root").select("node", "twin", "component_id"), ["node", "twin"], "left"
    )
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
