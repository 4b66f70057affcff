"""N-gram Jaccard join with PartEnum signatures.

Sets of word shingles are joined exactly: every link (intersection at least ``4/5`` of the union) is
found, and nothing else.

**Signatures.** Sets are dealt into size bands [2^i, 2^(i+1)). Two linked sets of sizes a and b differ
in at most (a + b) // 9 shingles. In each band that a partner may lie in, the domain of shingles is
partitioned by a hash, and each subset of one partition gives a signature: the hash of the shingles
that the set has there. Sets that differ in k shingles agree in all but k partitions, so sets with at
least k + 1 usable partitions share a signature.

**Frequent shingles.** A signature is light if at most ``BUCKET`` sets have it. Only light signatures
make candidate pairs, so a bucket makes a bounded number. A set with k + 1 light signatures is covered:
each of its partners agrees with it in one of them. What is not covered, above all large groups of near
copies, is signed again with more and smaller partitions. What is still not covered is handled exactly
by its buckets: the members of each are tied to a hub, and only members that do not end up in one
component with each other are compared, in blocks of bounded size.

**Verification.** A bitmap of the parities of hashed shingles gives a lower bound of the difference, so
that few pairs remain; these are verified on the whole sets, first each set's pair with the partner that
seems nearest, then all pairs that these links have not yet brought together.

Equal sets are one class from the start. Nothing is sampled, capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import Bitmap, from_scratch, prepare_workers, quoted, slices
from .components import components

WORDS = 5
#: Sets of a light signature at most; they make at most 496 candidate pairs.
BUCKET = 32
#: Partitions per shingle of a band's largest set, in the first and the second signing.
FIRST, SECOND = 0.25, 1.0
BLOCK = 2048
#: Width of the bitmaps of dense buckets, in those of the others, and the last band that has them.
WIDE, WIDE_BANDS = 8, 10
_CHUNK = 400_000
#: Tells the bands of a set apart where one number stands for both.
_BAND = 0x9E3779B1
_U = np.uint64
_PLACES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_LOWERED = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), np.uint8)
_INSIDE = ~np.isin(np.arange(256), [32, *range(9, 14)])
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _PLACES[0])
_LENGTH = _U(0x589965CC75374CC3)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes begins, and its 64-bit hash: a sum over bytes and places, mixed."""
    inside = _INSIDE[data]
    turns = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    firsts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), _PLACES[1]))
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(firsts, sizes).astype(np.int32)
    return starts, _mix(np.add.reduceat(_BYTES[_LOWERED[data[inside]]] * powers[place], firsts))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; with fewer words, of the whole sequence."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not parts:
        return []
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    starts, hashes = _word_hashes(np.frombuffer(b" ".join([*parts, b""]), np.uint8))
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    counts = np.diff(first, append=len(starts))
    total = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        total += hashes[i : i + len(total)] * _PLACES[i]
    total = _mix(total)
    found = []
    for at, n in zip(first.tolist(), counts.tolist()):
        if n >= WORDS:
            found.append(np.unique(total[at : at + n - WORDS + 1]))
        else:
            whole = (hashes[at : at + n] * np.array(_PLACES[:n], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            found.append(_mix(whole ^ (np.array([n], np.uint64) * _LENGTH)) if n else whole[:0])
    return found


def _keys(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    parts = (_mix(values ^ _U(0x1B873593CC9E2D51)).sum(), _mix(values ^ _U(0x38495AB5E6546B64)).sum())
    return tuple(int(p.view(np.int64)) for p in parts)


def _levels(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each band with the sets that a pair whose larger set lies in it may have, and how far they may differ."""
    top = sizes * 5 // 4
    for level in range(int(max(top.max(initial=1), 1)).bit_length()):
        first, last = 1 << level, (2 << level) - 1
        chosen = np.flatnonzero((sizes <= last) & (top >= first))
        if len(chosen):
            yield level, chosen, (sizes[chosen] + np.minimum(top[chosen], last)) // 9


def _signatures(sets: list[np.ndarray], sizes: np.ndarray, share: float, seed: int):
    """Per band: its number, the sets, how far they may differ, and (set, signature) of all non-empty partitions."""
    for level, chosen, k in _levels(sizes):
        chosen, k = chosen[k > 0], k[k > 0]  # sets that may not differ are equal, and so of one class
        if not len(chosen):
            continue
        n = int(((2 << level) - 1) * share) + 3
        values = _mix(np.concatenate([sets[i] for i in chosen.tolist()]) ^ _U(int(_PLACES[seed]) * (level + 1) % 2**64))
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
        part = owner * n + ((values >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        held, part = np.add.reduceat(_mix(values)[order], starts), part[starts]
        signature = _mix(held + (part % n).astype(np.uint64) * _PLACES[3]) & ~_U(31) | _U(level)
        yield level, chosen, k, part // n, signature.view(np.int64)


def _bitmaps(sets: list[np.ndarray], sizes: np.ndarray, scale: int = 1) -> list[list[bytes | None]]:
    """For each set the parities of its shingles, in its own band's width and in the next one's.

    Sets differ in as many shingles as their bitmaps in bits, at least; the wider, the closer.
    """
    found: list[list[bytes | None]] = [[None, None] for _ in sets]
    for level, chosen, _ in _levels(sizes):
        width = max(8, scale * (2 << level))
        values = np.concatenate([sets[i] for i in chosen.tolist()])
        place = np.repeat(np.arange(len(chosen)) * width, sizes[chosen]) + (values >> _U(20) & _U(width - 1)).astype(np.int64)
        bits = np.packbits((np.bincount(place, minlength=width * len(chosen)) & 1).astype(bool)).reshape(len(chosen), -1)
        for row, i in enumerate(chosen.tolist()):
            found[i][level + 1 - int(sizes[i]).bit_length()] = bits[row].tobytes()
    return found


def _sets_of(batches: Iterator[pa.RecordBatch], size: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", size):
        yield batch, shingle_sets(batch.column("text").to_pylist())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets_of(batches):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = [_keys(s) if len(s) else (None, None) for s in sets]
        own, following = zip(*_bitmaps(sets, sizes))
        columns = [
            batch.column("doc_id"), pa.array(sizes), pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int64()), pa.array(own, pa.binary()), pa.array(following, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "twin", "own", "following"])


SIGNATURE, MARK, SPARE = 0, 1, 2
_SIGNED = "kind tinyint, sig bigint, node bigint, value int"


def _rows(kind: np.ndarray, sig: np.ndarray, node: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(sig), 100_000):
        part = slice(i, i + 100_000)
        arrays = [pa.array(kind[part], pa.int8()), pa.array(sig[part]), pa.array(node[part]), pa.array(value[part], pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["kind", "sig", "node", "value"])


def _in_band(node: Column) -> Column:
    """What stands for a set and its band ``level``, as ``node ^ level * _BAND`` does in a task."""
    return node.bitwiseXOR(F.col("level") * F.lit(_BAND))


def _sign(share: float, seed: int, wanted: Bitmap | None = None):
    """Signature rows of one partition: each class once, and no signature of more sets than a bucket holds.

    ``wanted`` names the sets and bands to sign (``_in_band``); without it all are.

    A signature with more sets in this chunk is sent as a mark only, as it can't be light, and taken
    off what its sets have to spare.
    """

    def flush(sig, node, size, spare: dict) -> Iterator[pa.RecordBatch]:
        sig, node, size = (np.concatenate(x) for x in (sig, node, size))
        order = np.argsort(sig, kind="stable")
        sig, node, size = sig[order], node[order], size[order]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        counts = np.diff(starts, append=len(sig))
        heavy = np.repeat(counts > BUCKET, counts)
        for key in zip(node[heavy].tolist(), (sig[heavy] & 31).tolist()):
            spare[key] -= 1
        marks = sig[starts[counts > BUCKET]]
        light = ~heavy
        yield from _rows(np.full(light.sum(), SIGNATURE), sig[light], node[light], size[light])
        yield from _rows(np.full(len(marks), MARK), marks, np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int32))
        nodes = np.array([k[0] for k in spare], np.int64)
        bands = np.array([k[1] for k in spare], np.int64)
        places = (_mix(nodes.view(np.uint64)) & ~_U(31)).view(np.int64) | bands
        yield from _rows(np.full(len(nodes), SPARE), places, nodes, np.array(list(spare.values()), np.int32))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node, size, spare, held, seen = [], [], [], {}, 0, set()
        for _, sets in _sets_of(batches):
            fresh, nodes = [], []
            for s in sets:
                key = _keys(s)[0] if len(s) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh.append(s)
                    nodes.append(key)
            if not fresh:
                continue
            sizes, nodes = np.fromiter(map(len, fresh), np.int64, len(fresh)), np.array(nodes, np.int64)
            for level, chosen, k, owner, found in _signatures(fresh, sizes, share, seed):
                usable = np.bincount(owner, minlength=len(chosen))
                taken = np.full(len(chosen), True) if wanted is None else wanted.may_hold(nodes[chosen] ^ np.int64(level * _BAND))
                if not taken.any():
                    continue
                for i, left in zip(nodes[chosen][taken].tolist(), (usable - k - 1)[taken].tolist()):
                    spare[(i, level)] = left
                found, owner = found[taken[owner]], owner[taken[owner]]
                sig.append(found)
                node.append(nodes[chosen][owner])
                size.append(sizes[chosen][owner].astype(np.int32))
                held += len(found)
            if held >= _CHUNK:
                yield from flush(sig, node, size, spare)
                sig, node, size, spare, held, seen = [], [], [], {}, 0, set()
        if held:
            yield from flush(sig, node, size, spare)

    return signed


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of signature: pairs (a < b) of light ones, and (node, band) for each set of heavy ones."""
    names = ("kind", "sig", "node", "value")
    kept = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in names]
        now = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
        whole = int(np.searchsorted(now[1], now[1][-1]))
        kept = [x[whole:] for x in now]
        if whole:
            yield from _met(*(x[:whole] for x in now))
    if kept is not None:
        yield from _met(*kept)


def _met(kind, sig, node, value) -> Iterator[pa.RecordBatch]:
    spare = kind == SPARE
    yield _result(SPARE, node[spare], sig[spare] & 31, value[spare])
    marked = np.unique(sig[kind == MARK])
    row = kind == SIGNATURE
    sig, node, value = sig[row], node[row], value[row].astype(np.int64)
    order = np.lexsort((node, sig))
    sig, node, value = sig[order], node[order], value[order]
    if not len(sig):
        return
    first = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node, value = sig[first], node[first], value[first]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    counts = np.diff(starts, append=len(sig))
    heavy = np.repeat((counts > BUCKET) | np.isin(sig[starts], marked), counts)
    yield _result(MARK, node[heavy], sig[heavy] & 31, np.ones(heavy.sum(), np.int32))
    shared = ~heavy & np.repeat(counts > 1, counts)
    sig, node, value = sig[shared], node[shared], value[shared]
    a, b = [], []
    for gap in range(1, BUCKET):
        x = np.flatnonzero(sig[gap:] == sig[:-gap]) if gap < len(sig) else []
        if not len(x):
            break
        small, large = np.minimum(value[x], value[x + gap]), np.maximum(value[x], value[x + gap])
        x = x[small * 5 >= large * 4]
        a.append(node[x])
        b.append(node[x + gap])
    if a:
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        yield _result(SIGNATURE, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int32))


def _result(kind: int, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(a), kind), pa.int8()), pa.array(a), pa.array(b.astype(np.int64)), pa.array(value, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "a", "b", "value"])


def _signed_pairs(rows: DataFrame) -> DataFrame:
    """Of one signing's rows: pairs to test (kind 0: a, b), and what each (node a, band b) has to spare (1: less, 2: at first)."""
    met = rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(from_scratch(_meet), "kind tinyint, a bigint, b bigint, value int")
    return stored(met)


def _uncovered(met: DataFrame) -> DataFrame:
    """(node, level) with fewer light signatures than needed."""
    spare = F.max(F.when(F.col("kind") == SPARE, F.col("value")))
    lost = F.count(F.when(F.col("kind") == MARK, 1))
    rows = met.where(F.col("kind") != SIGNATURE).groupBy(F.col("a").alias("node"), F.col("b").alias("level"))
    return rows.agg(spare.alias("spare"), lost.alias("lost")).where("spare < lost").select("node", "level")


def _only(docs: DataFrame, ids: DataFrame, then, schema: str) -> DataFrame:
    """``then`` over the batches (text) of documents with these ids, and of a few others."""
    wanted = Bitmap(ids.select(F.xxhash64("doc_id")))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = wanted.may_hold(batch.column("place").to_numpy())
            if some.any():
                yield batch.select(["text"]).filter(pa.array(some))

    return docs.select(F.xxhash64("doc_id").alias("place"), "text").mapInArrow(from_scratch(lambda batches: then(chosen(batches))), schema)


def _restricted(docs: DataFrame, classes: DataFrame, nodes: DataFrame, then, schema: str) -> DataFrame:
    """``then`` over the batches of the documents that stand for some classes, and of a few others.

    The others grow with documents times classes while the bitmap is small, so ``then`` has to look at the
    sets themselves before it makes rows of them.
    """
    ids = classes.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"))
    return _only(docs, ids, then, schema)


def _emit_sets(wanted: Bitmap):
    """The sets whose node may be wanted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches, 250_000):
            sets = [s for s in sets if len(s)]
            keys = np.array([_keys(s) for s in sets], np.int64).reshape(-1, 2)
            some = np.flatnonzero(wanted.may_hold(keys[:, 0]))
            columns = [
                pa.array(keys[some, 0]), pa.array(keys[some, 1]),
                pa.array([sets[i].view(np.int64) for i in some.tolist()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "twin", "shingles"])

    return emit


def _emit_dense(wanted: Bitmap):
    """The first k + 1 signatures of each wanted set and band; sets with fewer also share one signature of the band."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches, 250_000):
            sets = [s for s in sets if len(s)]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            if not sets:
                continue
            maps, nodes = _bitmaps(sets, sizes, WIDE), np.array([_keys(s)[0] for s in sets], np.int64)
            for level, chosen, k, owner, found in _signatures(sets, sizes, FIRST, 0):
                named = wanted.may_hold(nodes[chosen] ^ np.int64(level * _BAND))
                usable = np.bincount(owner, minlength=len(chosen))
                rank = np.arange(len(owner)) - (np.cumsum(usable) - usable)[owner]
                taken = (rank <= k[owner]) & named[owner]
                few = np.flatnonzero((usable <= k) & named)
                owner = np.concatenate([owner[taken], few])
                found = np.concatenate([found[taken], np.full(len(few), level)])
                at = chosen[owner]
                # a long text has many rows; its bitmap would be repeated in each
                bits = [maps[i][level + 1 - int(sizes[i]).bit_length()] if level <= WIDE_BANDS else b"" for i in at.tolist()]
                columns = [pa.array(found), pa.array(nodes[at]), pa.array(np.full(len(at), level)), pa.array(sizes[at]), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "node", "level", "n", "bits"])

    return emit


def _differing(own: pa.Array, other: pa.Array) -> np.ndarray:
    """Number of differing bits of bitmaps of equal width."""
    a, b = (x.cast(pa.large_binary()) for x in (own, other))
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    ends = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
    left = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    right = np.frombuffer(b.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    counts = np.concatenate([[0], np.cumsum(np.bitwise_count(left ^ right), dtype=np.int64)])
    return np.diff(counts[offsets - offsets[0]])


def _close(own: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array(_differing(own, other) if len(own) else [], pa.int64())


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes and bitmaps of their sets allow."""
    facts = [F.col("node"), F.col("n"), F.col("own"), F.col("following"), F.length(F.bin("n")).alias("band")]
    a = classes.select(*facts).toDF("a", "a_n", "a_own", "a_following", "a_band")
    b = classes.select(*facts).toDF("b", "b_n", "b_own", "b_following", "b_band")
    both = pairs.distinct().join(a, "a").join(b, "b").where(
        (F.least("a_n", "b_n") * 5 >= F.greatest("a_n", "b_n") * 4) & (F.abs(F.col("a_band") - F.col("b_band")) <= 1)
    )
    left = F.when(F.col("a_band") >= F.col("b_band"), F.col("a_own")).otherwise(F.col("a_following"))
    right = F.when(F.col("b_band") >= F.col("a_band"), F.col("b_own")).otherwise(F.col("b_following"))
    bound = F.floor((F.col("a_n") + F.col("b_n")) / 9)
    compared = both.select("a", "b", bound.alias("bound"), left.alias("left"), right.alias("right"))
    compared = compared.where("left IS NOT NULL AND right IS NOT NULL")
    # not deterministic for Spark, or it would run the step once for the filter and once for the column, in two workers a task
    apart = F.arrow_udf(_close, "bigint").asNondeterministic()
    return compared.select("a", "b", "bound", apart("left", "right").alias("apart")).where("apart <= bound").select("a", "b", "apart")


def _nearest(close: DataFrame) -> DataFrame:
    """For each set its pair with the partner that seems nearest."""
    ends = close.select(F.col("a").alias("x"), F.col("b").alias("y"), "apart").unionByName(close.select(F.col("b").alias("x"), F.col("a").alias("y"), "apart"))
    first = ends.groupBy("x").agg(F.min_by("y", F.col("apart") * 256 + F.pmod(F.xxhash64("y"), F.lit(256))).alias("y"))
    return first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _across(close: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are not in one component yet."""
    label = roots.select("node", "root")
    both = close.join(label.toDF("a", "a_root"), "a").join(label.toDF("b", "b_root"), "b")
    return both.where("a_root <> b_root").select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b between class numbers) of those pairs whose whole sets are similar enough."""
    nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = _restricted(docs, classes, nodes, _emit_sets(Bitmap(nodes)), "node bigint, twin bigint, shingles array<bigint>")
    sides = [sets.select(*(F.col(c).alias(f"{side}_{c}") for c in sets.columns)) for side in ("x", "y")]
    both = pairs.join(sides[0], F.col("a") == F.col("x_node")).join(sides[1], F.col("b") == F.col("y_node"))
    shared = F.size(F.array_intersect("x_shingles", "y_shingles"))
    sized = both.select("x_node", "x_twin", "y_node", "y_twin", shared.alias("shared"), (F.size("x_shingles") + F.size("y_shingles")).alias("total"))
    links = sized.where(100 * F.col("shared") >= 80 * (F.col("total") - F.col("shared")))
    number = classes.select("node", "twin", "number")
    named = links.join(number.toDF("x_node", "x_twin", "a"), ["x_node", "x_twin"]).join(number.toDF("y_node", "y_twin", "b"), ["y_node", "y_twin"])
    return stored(named.select("a", "b").distinct())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (sig, i, j): pairs of members of blocks i and j in different components that may be close."""
    kept: list[pa.RecordBatch] = []
    key = lambda batch, at: tuple(batch.column(c)[at].as_py() for c in ("sig", "i", "j"))
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            if kept and key(kept[0], 0) != key(part, 0):
                yield _block(kept)
                kept = []
            kept.append(part)
    if kept:
        yield _block(kept)


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    node, n, root, block = (rows.column(c).to_numpy() for c in ("node", "n", "root", "block"))
    parts = rows.column("bits").to_pylist()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    bits = np.frombuffer(b"".join(parts), np.uint8).reshape(len(node), len(parts[0]))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    step = max(1, 4_000_000 // max(1, len(right) * max(8, bits.shape[1])))
    a, b = [], []
    for at in range(0, len(left), step):
        x = left[at : at + step]
        apart = np.bitwise_count(bits[x][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int64)
        sizes = n[x][:, None] + n[right][None, :]
        fits = (apart <= sizes // 9) & (root[x][:, None] != root[right][None, :]) & (node[x][:, None] != node[right][None, :])
        p, q = np.nonzero(fits)
        a.append(node[x][p])
        b.append(node[right][q])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _apart(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets that share a dense bucket, are not in one component, and may be close."""
    rows = dense.join(labels, "node")
    mixed = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
    mixed = mixed.where("lo <> hi").select("sig", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    found = rows.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    dealt = found.select("sig", "node", "n", "bits", "root", "block", other.alias("other"))
    dealt = dealt.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    ordered = dealt.select("sig", "i", "j", "node", "n", "bits", "root", "block").repartition("sig", "i", "j")
    return ordered.sortWithinPartitions("sig", "i", "j").mapInArrow(from_scratch(_blocks), "a bigint, b bigint").distinct()


def _signed_again(texts: DataFrame, classes: DataFrame, left: DataFrame) -> DataFrame:
    """Signature rows of the second signing: of the sets and bands (node, level) that the first one left, and of very few others."""
    wanted = Bitmap(left.select(_in_band(F.col("node"))))
    return _restricted(texts, classes, left, _sign(SECOND, 1, wanted), _SIGNED)


def _roots(classes: DataFrame, links: DataFrame) -> DataFrame:
    """node, number, root of every class; a class without links is its own root."""
    labels = components(links).toDF("number", "root")
    return classes.select("node", "number").join(labels, "number", "left").select("node", "number", F.coalesce("root", "number").alias("root"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, n, node, twin), classes of equal sets (number, node, twin, n, rep), and links (a, b) of class numbers.

    The links connect all that is connected; links inside a component that they already connect may be
    left out, but none between two components is.
    """
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)
    texts = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    schema = "doc_id bigint, n bigint, node bigint, twin bigint, own binary, following binary"
    members = stored(texts.mapInArrow(from_scratch(_members), schema))
    grouped = members.where("n > 0").groupBy("node", "twin").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("own").alias("own"), F.max("following").alias("following")
    )
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("number"), "*"))

    first = _signed_pairs(texts.select("text").mapInArrow(from_scratch(_sign(FIRST, 0)), _SIGNED))
    pairs, left = first.where(F.col("kind") == SIGNATURE).select("a", "b"), stored(_uncovered(first))
    dense = None
    if not left.isEmpty():
        second = _signed_pairs(_signed_again(texts, classes, left))
        pairs = pairs.unionByName(second.where(F.col("kind") == SIGNATURE).select("a", "b"))
        left = stored(left.join(_uncovered(second), ["node", "level"], "left_semi"))
        if not left.isEmpty():
            kind = "sig bigint, node bigint, level bigint, n bigint, bits binary"
            rows = _restricted(texts, classes, left, _emit_dense(Bitmap(left.select(_in_band(F.col("node"))))), kind)
            dense = stored(rows.join(left, ["node", "level"], "left_semi").distinct().select("sig", "node", "n", "bits"))
            # another hub in each bucket: a set meets as many of them as it has signatures
            hubs = dense.groupBy("sig").agg(F.min_by("node", F.xxhash64("node", "sig")).alias("hub"))
            stars = dense.join(hubs, "sig").where("node <> hub")
            pairs = pairs.unionByName(stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")))
    close = stored(_filtered(pairs, classes))
    links = _verified(_nearest(close), texts, classes)
    roots = stored(_roots(classes, links))
    rest = stored(_across(close, roots))
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, classes))
        roots = stored(_roots(classes, links)) if dense is not None else roots
    if dense is not None:
        rest = stored(_filtered(_apart(dense, roots.select("node", "root")), classes).select("a", "b"))
        if not rest.isEmpty():
            links = links.unionByName(_verified(rest, texts, classes))
    return members.select("doc_id", "n", "node", "twin"), classes, links


def _component_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, node, twin and component_id of every row; component_id is null where there are no shingles."""
    members, classes, links = jaccard_classes(docs, id_col, text_col)
    named = classes.join(_roots(classes, links).select("number", "root"), "number")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = named.join(smallest, "root").select("node", "twin", "component_id")
    return members.join(found, ["node", "twin"], "left").select("doc_id", "n", "node", "twin", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row.

    Defined results: a text without words, or a null one, has no shingles and is linked with nothing; a
    text with fewer words than a shingle has one. Rows that repeat each have a row, in one component. A
    null id has a row too, and is a component's id only where no other id is in it. An empty table has
    no rows; other columns are not read.
    """
    alone: Column = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return _component_of(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is their component's, and those without shingles.

    Rows that share an id are one document. Of rows without id those stay whose component has no id.
    Only rows whose id may be one that goes are shuffled.
    """
    found = stored(_component_of(docs, id_col, text_col))
    gone = found.where((F.col("n") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), "node", "twin").distinct()
    listed = Bitmap(gone.select(F.xxhash64("gone_id")))

    def keys(place: pa.Array, text: pa.Array) -> pa.Array:
        """Whether a row's id may be one that goes, and if so what stands for its set: one step, and so one worker a task."""
        doubtful = listed.may_hold(place.to_numpy())
        chosen, found = np.flatnonzero(doubtful), [(None, None)] * len(text)
        part = pa.RecordBatch.from_arrays([text.take(pa.array(chosen))], ["text"])
        at = 0
        for _, sets in _sets_of(iter([part])):
            for s in sets:
                found[chosen[at]] = _keys(s) if len(s) else (None, None)
                at += 1
        fields = [pa.array(doubtful), *[pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)]]
        return pa.StructArray.from_arrays(fields, ["doubtful", "node", "twin"])

    row = F.struct(*[quoted(c) for c in docs.columns]).alias("document")
    bigint = quoted(id_col).cast("bigint")
    key = F.arrow_udf(keys, "doubtful boolean, node bigint, twin bigint").asNondeterministic()(F.xxhash64(bigint), quoted(text_col))
    marked = docs.select(row, bigint.alias("id"), key.alias("k"))
    sure = marked.where("NOT k.doubtful").select("document.*")
    named = marked.where("k.doubtful").select("document", "id", "k")
    goes = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("k.node") == F.col("node")) & (F.col("k.twin") == F.col("twin"))
    return sure.unionByName(named.join(gone, goes, "left_anti").select("document.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
