"""Removal of repeated byte strings: suffixes in deep-shallow order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in its own
document or another.

**Anchors.** Of the ``GRAM``-byte strings inside a window of LENGTH bytes, the one with the smallest hash
(the leftmost of equals) is the window's anchor. Equal windows have their anchor at the same place, so
only windows with equal anchors can be equal, and an anchor stands for a run of windows. Only anchors
that occur more than once are looked at further.

**Equal runs.** First the runs are compared as wholes: an aggregate counts them by anchor and by a hash of
all bytes their windows hold. Runs that occur more than once are repeated; of each such kind one stays
as an example for the rest. Where all runs of an anchor are of one kind nothing else is to do.

**Sorting.** The suffixes that begin after equal anchors of different kinds of runs are sorted: multikey quicksort to a shallow
depth, then blind tries for groups that agree so far, as repeats do. The common prefixes of neighbours
and the common bytes before the anchors say which windows of a run are repeated.

**Frequent anchors.** An anchor with more than ``COLD`` kinds of runs is not sorted in one task. Its runs are
cut into parts of ``PART`` windows, and aggregates count 128-bit hashes of what all windows of a part
hold and of all that they hold. A part whose common bytes occur once has no repeated window; one that
occurs whole more than once has no other. Only of the parts between, at the edges of what documents
share, the windows themselves are counted. So a passage in a third of all documents sends few rows per
document, and no task gets them all. Equal texts are one class from the start; classes of several rows
are repeated as a whole. Nothing is sampled, capped or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import Bitmap, prepare_workers, quoted, slices

LENGTH = 400
GRAM = 100
COLD = 64
#: Windows of a part.
PART = 16
SHALLOW = 12
_U = np.uint64
_SLICE = 500_000
_STEP = 1 << 20
_CHUNK = 500_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class _Rolling:
    """Hashes of all strings of one length: sums of table values times powers of an odd base."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * _U(base))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            size = len(data) + 1
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                steps = np.full(size, _U(base))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def all(self, sums: np.ndarray, size: int) -> np.ndarray:
        return _mix((sums[size:] - sums[:-size]) * self.inverses[: len(sums) - size])

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])


_rolling = tuple(_Rolling(b) for b in _BASES)


def text_key(data: bytes) -> tuple[int, int]:
    """128 bits that stand for a text, as two signed numbers."""
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(data), np.int64))


def _smallest(codes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        codes = np.minimum(codes[:-size], codes[size:])
        size *= 2
    return np.minimum(codes[: len(codes) - (width - size)], codes[width - size :]) if size < width else codes


@dataclass(frozen=True)
class _Parts:
    """Some neighbouring windows of a run each: the run, first and last window, what all of them hold (128 bits), and all they hold."""

    run: np.ndarray
    first: np.ndarray
    last: np.ndarray
    core1: np.ndarray
    core2: np.ndarray
    whole: np.ndarray


class _Runs:
    """Anchors of some pieces of texts, and the run of windows that each stands for.

    ``piece``, ``anchor``, ``first``, ``last``: piece number, and places in ``data`` of the anchor and
    of its first and last window.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(sizes) - sizes
        self.data = b"".join(pieces)
        data = np.frombuffer(self.data, np.uint8)
        self.sums = _rolling[0].prefix(data)
        grams = _rolling[0].all(self.sums, GRAM)
        mask = (1 << len(data).bit_length()) - 1
        codes = grams & _U(2**64 - 1 - mask) | np.arange(len(grams), dtype=np.uint64)
        least = _smallest(codes, LENGTH - GRAM + 1)
        windows = sizes - LENGTH + 1
        place = np.repeat(self.starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        piece = np.repeat(np.arange(len(pieces)), windows)
        anchor = (least[place] & _U(mask)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
        end = np.append(begin[1:], len(anchor)) - 1
        self.piece, self.anchor, self.first, self.last = piece[begin], anchor[begin], place[begin], place[end]
        self.hashes = grams[self.anchor].view(np.int64)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the bytes between some places."""
        if not hasattr(self, "others"):
            self.others = _rolling[1].prefix(np.frombuffer(self.data, np.uint8))
        return _rolling[0].between(self.sums, starts, ends), _rolling[1].between(self.others, starts, ends)

    def parts(self, some: np.ndarray) -> _Parts:
        """The windows of some runs in parts of at most PART neighbours, cut at multiples of PART before the anchor."""
        low, high = (self.anchor - self.last)[some], (self.anchor - self.first)[some]
        counts = high // PART - low // PART + 1
        run = np.repeat(np.arange(len(some)), counts)
        grid = (low // PART)[run] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        anchor = self.anchor[some][run]
        near, far = np.maximum(grid * PART, low[run]), np.minimum(grid * PART + PART - 1, high[run])
        core = self.between(anchor - grid * PART, anchor - grid * PART + LENGTH - PART + 1)
        return _Parts(some[run], anchor - far, anchor - near, *core, self.wholes(anchor, anchor - far, anchor - near))

    def wholes(self, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64 bits that stand for all bytes of the windows from first to last, and for where they lie about the anchor."""
        one, two = self.between(first, last + LENGTH)
        return _mix(one ^ _mix(two + ((anchor - last) * LENGTH + anchor - first).astype(np.uint64)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, list[bytes], bool]]:
    """Keys, offsets and bytes of the pieces of the texts, each class of equal texts once in a chunk; and whether a chunk begins."""
    seen: set[tuple[int, int]] = set()
    held, new = 0, True
    for batch in slices(batches, "text", _SLICE):
        keys, offsets, parts = [], [], []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            key = text_key(data)
            if len(data) < LENGTH or key in seen:
                continue
            seen.add(key)
            for at in range(0, len(data) - LENGTH + 1, _STEP):
                keys.append(key)
                offsets.append(at)
                parts.append(data[at : at + _STEP + LENGTH - 1])
        if parts:
            yield keys, np.array(offsets, np.int64), parts, new
            held, new = held + sum(map(len, parts)), False
            if held > 64 * _CHUNK:
                seen, held, new = set(), 0, True


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["hash", "n"])

    held, size = [], 0
    for _, _, parts, _ in _pieces(batches):
        held.append(_Runs(parts).hashes)
        size += len(held[-1])
        if size > _CHUNK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


_RUN = "hash bigint, whole bigint, k1 bigint, k2 bigint, anchor bigint, first bigint, last bigint"
_SUFFIX = pa.schema([("hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("body", pa.binary())])


def _shared_runs(shared: Bitmap):
    """A row for each run whose anchor occurs elsewhere."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, pieces, _ in _pieces(batches):
            runs = _Runs(pieces)
            some = np.flatnonzero(shared.may_hold(runs.hashes))
            anchor, first, last = (x[some] for x in (runs.anchor, runs.first, runs.last))
            whole = runs.wholes(anchor, first, last).view(np.int64)
            k1, k2, shift = _placed(keys, offsets, runs, some)
            yield from _batches_of([runs.hashes[some], whole, k1, k2, anchor + shift, first + shift, last + shift], _RUN)

    return emit


class _Examples:
    """Examples of runs (hash, k1), by anchor hash and text; few other runs pass, as the anchor itself has to be theirs too."""

    def __init__(self, rows: DataFrame) -> None:
        self.places = Bitmap(rows.select(F.col("hash").bitwiseXOR(F.col("k1"))))
        self.anchors = Bitmap(rows.select("hash").distinct())

    def may_hold(self, hashes: np.ndarray, k1: np.ndarray) -> np.ndarray:
        return self.places.may_hold(hashes ^ k1) & self.anchors.may_hold(hashes)


def _chosen(runs: _Runs, keys: list, offsets: np.ndarray, examples: _Examples) -> np.ndarray:
    """Of runs that are examples, one of each kind among these pieces."""
    k1, _, _ = _placed(keys, offsets, runs, np.arange(len(runs.hashes)))
    some = np.flatnonzero(examples.may_hold(runs.hashes, k1))
    whole = runs.wholes(*(x[some] for x in (runs.anchor, runs.first, runs.last)))
    _, one = np.unique(np.stack([runs.hashes[some].view(np.uint64), whole], 1), axis=0, return_index=True)
    return some[np.sort(one)]


def _suffixes(examples: _Examples):
    """Rows for the sort: examples of runs, with the bytes of their windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, parts, _ in _pieces(batches):
            runs = _Runs(parts)
            some = _chosen(runs, keys, offsets, examples)
            anchor, first, last = (x[some] for x in (runs.anchor, runs.first, runs.last))
            body = [runs.data[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
            k1, k2, shift = _placed(keys, offsets, runs, some)
            columns = [pa.array(x) for x in (runs.hashes[some], k1, k2, anchor + shift, first + shift, last + shift)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(body, pa.binary())], schema=_SUFFIX)

    return emit


_PART = "c1 bigint, c2 bigint, whole bigint, k1 bigint, k2 bigint, anchor bigint, first bigint, last bigint"
_WINDOW = "w1 bigint, w2 bigint, k1 bigint, k2 bigint, anchor bigint, start bigint, n int"


def _batches_of(columns: list[np.ndarray], schema: str) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    for at in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], names)


def _placed(keys: list, offsets: np.ndarray, runs: _Runs, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text keys of some runs, and what to add to their places to count from their texts' starts."""
    piece = runs.piece[run]
    named = np.array(keys, np.int64).reshape(-1, 2)[piece]
    return named[:, 0], named[:, 1], (offsets - runs.starts)[piece]


def _example_parts(examples: _Examples):
    """The parts of examples of runs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, pieces, _ in _pieces(batches):
            runs = _Runs(pieces)
            p = runs.parts(_chosen(runs, keys, offsets, examples))
            k1, k2, shift = _placed(keys, offsets, runs, p.run)
            hashes = [x.view(np.int64) for x in (p.core1, p.core2, p.whole)]
            yield from _batches_of([*hashes, k1, k2, runs.anchor[p.run] + shift, p.first + shift, p.last + shift], _PART)

    return emit


def _mixed_windows(examples: _Examples, mixed: Bitmap, kinds: Bitmap):
    """Rows (window, place, n) of parts that share their common bytes, but not all, with others; n is 2 for repeats here.

    ``kinds`` names, by whole and text, one part of each kind: a part of which there are more is repeated
    as a whole, and of its copies one is enough to find its windows again in parts that occur once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, pieces, _ in _pieces(batches):
            runs = _Runs(pieces)
            p = runs.parts(_chosen(runs, keys, offsets, examples))
            named, _, _ = _placed(keys, offsets, runs, p.run)
            chosen = np.flatnonzero(mixed.may_hold(p.core1.view(np.int64)) & kinds.may_hold(p.whole.view(np.int64) ^ named))
            if not len(chosen):
                continue
            counts = (p.last - p.first + 1)[chosen]
            part = np.repeat(chosen, counts)
            place = np.repeat(p.first[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            w1, w2 = runs.between(place, place + LENGTH)
            order = np.lexsort((w2, w1))
            new = np.concatenate([[True], (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            often = (np.bincount(number) > 1)[number]
            # of windows that repeat here, one place each, and in each part the first and the last place
            sent = ~often
            sent[order[new]] = True
            here = np.flatnonzero(often)
            turn = part[here][1:] != part[here][:-1]
            sent[here[np.concatenate([[True], turn])[: len(here)]]] = True
            sent[here[np.concatenate([turn, [True]])[: len(here)]]] = True
            run, place, w1, w2, often = p.run[part[sent]], *(x[sent] for x in (place, w1, w2, often))
            k1, k2, shift = _placed(keys, offsets, runs, run)
            n = np.where(often, 2, 1).astype(np.int32)
            yield from _batches_of([w1.view(np.int64), w2.view(np.int64), k1, k2, runs.anchor[run] + shift, place + shift, n], _WINDOW)

    return emit


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class _BlindTrie:
    """Orders strings that agree far: nodes hold only the depth where strings part, and the bytes there."""

    def __init__(self, texts: list[bytes], first: int) -> None:
        self.texts = texts
        self.root: object = [first]

    def _byte(self, i: int, depth: int) -> int:
        text = self.texts[i]
        return text[depth] if depth < len(text) else -1

    def add(self, i: int) -> None:
        node = self.root
        while isinstance(node, tuple):  # down to any string below, without comparing what the nodes skip
            depth, children = node
            node = children.get(self._byte(i, depth)) or next(iter(children.values()))
        other = node[0]
        apart = common_prefix(self.texts[i], self.texts[other])
        if self._byte(i, apart) == self._byte(other, apart):  # equal strings
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < apart:
            above, node = node, node[1][self._byte(i, node[0])]
        if isinstance(node, tuple) and node[0] == apart:
            node[1][self._byte(i, apart)] = [i]
            return
        parted = (apart, {self._byte(other, apart): node, self._byte(i, apart): [i]})
        if above is None:
            self.root = parted
        else:
            above[1][self._byte(i, above[0])] = parted

    def order(self) -> list[int]:
        found, pending = [], [self.root]
        while pending:
            node = pending.pop()
            if isinstance(node, tuple):
                pending += [child for _, child in sorted(node[1].items(), key=lambda x: -x[0])]
            else:
                found += node
        return found


def deep_shallow_order(texts: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in sorted order."""
    found: list[int] = []
    pending = [(list(range(len(texts))), 0)]
    while pending:
        group, depth = pending.pop()
        if len(group) == 1:
            found += group
        elif depth >= shallow:
            trie = _BlindTrie(texts, group[0])
            for i in group[1:]:
                trie.add(i)
            found += trie.order()
        elif group:
            pivot = texts[group[len(group) // 2]][depth : depth + 4]
            less, same, more = [], [], []
            for i in group:
                part = texts[i][depth : depth + 4]
                (same if part == pivot else less if part < pivot else more).append(i)
            pending += [(more, depth), (same, depth + 4 if len(pivot) == 4 else shallow), (less, depth)]
    return found


def _repeated(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, start, end) of what is repeated, of rows (k1, k2, anchor, first, last, body) with one anchor hash."""
    grams: dict[bytes, dict[tuple, tuple]] = {}  # of equal runs one: that they are repeated is known
    for row in rows:
        left = row[2] - row[3]
        grams.setdefault(row[5][left : left + GRAM], {}).setdefault((left, row[5]), (*row, row[5][left + GRAM :], row[5][:left][::-1]))
    for members in map(list, map(dict.values, grams.values())):
        if len(members) < 2:
            continue
        tails = [m[6] for m in members]
        order = deep_shallow_order(tails)
        shared = [GRAM + common_prefix(tails[a], tails[b]) for a, b in zip(order, order[1:])]
        for at, i in enumerate(order):
            k1, k2, anchor, first, last, _, _, before = members[i]
            nearest, farthest = anchor - last, anchor - first  # how far before the anchor its windows begin
            low, high = farthest + 1, nearest - 1
            for step in (1, -1):
                right, to = LENGTH, at
                while 0 <= to + step < len(order):
                    right = min(right, shared[to if step == 1 else to - 1])
                    to += step
                    if right + farthest < LENGTH:
                        break
                    other = members[order[to]]
                    if other[:3] == (k1, k2, anchor):
                        continue
                    least, most = max(nearest, LENGTH - right), min(farthest, common_prefix(before, other[7]))
                    if least <= most:
                        low, high = min(low, least), max(high, most)
            if low <= high:
                yield k1, k2, anchor - high, anchor - low + LENGTH


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of rows in order of anchor hash."""
    hash_now, group, out = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "k1", "k2", "anchor", "first", "last", "body"))):
            if row[0] != hash_now:
                out += _repeated(group)
                hash_now, group = row[0], []
            group.append(row[1:])
        if len(out) > 10_000:
            yield _spans(out)
            out = []
    yield _spans(out + list(_repeated(group)))


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "start", "end"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        keys = [text_key(d) for d in data]
        columns = [
            batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
            pa.array([k[1] for k in keys], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "k1", "k2", "sha256"])


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for span in sorted((s["start"], s["end"]) for s in spans):
        if found and span[0] <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], span[1]))
        else:
            found.append(span)
    return found


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, n_bytes, k1, k2, sha256), whole texts that repeat (k1, k2), and spans (k1, k2, start, end) of others.

    k1 and k2 stand for a text; start and end (exclusive) are in bytes; spans may overlap.
    """
    prepare_workers(docs.sparkSession)
    texts = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    members = stored(texts.mapInArrow(_members, "doc_id bigint, n_bytes bigint, k1 bigint, k2 bigint, sha256 string"))
    whole = members.where(F.col("n_bytes") >= LENGTH).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")

    bodies = texts.select("text").where(F.octet_length("text") >= LENGTH)
    counted = bodies.mapInArrow(_anchor_counts, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = stored(counted.where("n > 1"))
    runs = stored(bodies.mapInArrow(_shared_runs(Bitmap(counted.select("hash"))), _RUN))
    kinds = runs.groupBy("hash", "whole").agg(F.count("*").alias("n"), F.min("k1").alias("k1"))
    kinds = stored(kinds)
    equal = runs.join(kinds.where("n > 1").select("hash", "whole"), ["hash", "whole"])
    equal = equal.select("k1", "k2", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    differing = kinds.groupBy("hash").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    examples = stored(kinds.join(differing, "hash").select("kinds", "hash", "k1"))
    few = _Examples(examples.where(F.col("kinds") <= COLD))
    many = _Examples(examples.where(F.col("kinds") > COLD))

    suffixes = bodies.mapInArrow(_suffixes(few), "hash bigint, k1 bigint, k2 bigint, anchor bigint, first bigint, last bigint, body binary")
    ordered = suffixes.repartition("hash").sortWithinPartitions("hash")
    cold = ordered.mapInArrow(_sorted_groups, "k1 bigint, k2 bigint, start bigint, end bigint")

    parts = stored(bodies.mapInArrow(_example_parts(many), _PART))
    whole_counts = stored(parts.groupBy("c1", "c2", "whole").agg(F.count("*").alias("n"), F.min("k1").alias("k1")))
    often = whole_counts.where("n > 1").select("c1", "c2", "whole")
    mixed = whole_counts.groupBy("c1", "c2").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    mixed = stored(mixed.select("c1", "c2"))
    one_each = whole_counts.join(mixed, ["c1", "c2"]).select(F.col("whole").bitwiseXOR(F.col("k1")))
    hot = parts.join(often, ["c1", "c2", "whole"]).select("k1", "k2", "anchor", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    some = _mixed_windows(many, Bitmap(mixed.select("c1")), Bitmap(one_each))
    windows = stored(bodies.mapInArrow(some, _WINDOW))
    repeated = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.where("n = 1").join(repeated, ["w1", "w2"]).select("k1", "k2", "anchor", "start")
    places = windows.where("n > 1").select("k1", "k2", "anchor", "start").unionByName(single)
    hot = hot.unionByName(places.withColumn("end", F.col("start") + LENGTH))
    # all these windows hold their anchor, so that what they cover has no gap
    hot = hot.groupBy("k1", "k2", "anchor").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = stored(cold.unionByName(hot.select("k1", "k2", "start", "end")).unionByName(equal).distinct())
    return members, stored(whole), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Defined results: texts are their UTF-8 bytes, a null one is empty. Rows that repeat are copies of
    each other, so that texts of LENGTH bytes or more go as a whole; shorter ones have nothing to
    remove. Null ids are kept. An empty table has no rows; other columns are not read.
    """
    members, whole, spans = repeated_spans(docs, id_col, text_col)
    spans = spans.join(whole, ["k1", "k2"], "left_anti")
    listed = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    wanted = Bitmap(spans.select("k1").distinct())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            keys = np.array([text_key(d) for d in data], np.int64).reshape(-1, 2)
            some = np.flatnonzero(wanted.may_hold(keys[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[some, 0]), pa.array(keys[some, 1]), pa.array([data[i] for i in some.tolist()], pa.binary())], ["k1", "k2", "data"]
            )

    def cut(data: pa.Array, spans: pa.Array) -> pa.Array:
        result = []
        for body, found in zip(data.to_pylist(), spans.to_pylist()):
            merged, digest, at = _merged(found), hashlib.sha256(), 0
            for start, end in [*merged, (len(body), len(body))]:
                digest.update(body[at:start])
                at = end
            result.append({"n_removed": sum(e - s for s, e in merged), "n_spans": len(merged), "kept": digest.hexdigest()})
        return pa.array(result, pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())]))

    texts = docs.select(quoted(text_col).alias("text")).where(F.octet_length("text") >= LENGTH)
    bodies = texts.mapInArrow(chosen, "k1 bigint, k2 bigint, data binary")
    udf = F.arrow_udf(cut, "n_removed bigint, n_spans bigint, kept string")
    parts = bodies.join(listed, ["k1", "k2"]).select("k1", "k2", udf("data", "spans").alias("c")).select("k1", "k2", "c.*")
    copies = whole.select("k1", "k2", F.lit(True).alias("gone"))
    joined = members.join(copies, ["k1", "k2"], "left").join(parts, ["k1", "k2"], "left")
    gone = F.coalesce("gone", F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
