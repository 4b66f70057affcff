"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The patterns are the word windows of a benchmark. A search looks at the last two words under the
window's end: a pair that no pattern holds moves the window on by all but one of its words, and a word
that no pattern holds moves it past that word. A pair that ends some pattern selects a bucket of
places in the benchmark, and each is compared word by word.

The benchmark is the stated query set. It is cut into blocks of at most ``block_bytes`` of text by
size, and one block's tables at a time are broadcast; the usual benchmark is one block, and documents stay
where they are. With more blocks the rows are written once, each block keeps only the rows that it hits, and
only those rows are joined with their hits.

Items may share passages: each distinct window is held once, with the items that own it.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import Bitmap, held_by_worker, prepare_workers, quoted, slices, without

WINDOW = 10
BLOCK_BYTES = 8_000_000
#: Upper case letters as lower case; every other ASCII character but letters and digits as a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_FOUND = "n_words bigint, hits array<int>, items array<string>"
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; only A-Z are lower-cased, and all of what is not ASCII belongs to words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Patterns:
    """Shift tables and suffix buckets, one set for each window length; each distinct window once, with its owners."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.words: list[bytes] = []
        self.names: list[str] = []
        self.ids: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        ends = defaultdict(list)
        for name, text in items:
            words = words_of(text)
            if words:
                first, size = len(self.words), min(window, len(words))
                self.words += words
                for word in words:
                    self.ids.setdefault(word, len(self.ids))
                owner = -1 if name is None else numbers.setdefault(name, len(numbers))
                ends[size].append((first, len(words), owner))
        self.names = list(numbers)
        self.base = len(self.ids) + 1
        codes = np.fromiter((self.ids[w] for w in self.words), np.int32, len(self.words))
        self.groups = [(size, *self._tables(size, spans, codes)) for size, spans in sorted(ends.items())]

    def _tables(self, size: int, spans: list[tuple[int, int, int]], codes: np.ndarray) -> tuple:
        """Smallest shift of each word pair; the distinct windows that a pair ends; where windows begin; their owners."""
        shift: dict[int, int] = {}
        for first, n, _ in spans:
            own = codes[first : first + n].tolist()
            for end in range(0 if size == 1 else 1, n):
                key = (own[end - 1] if size > 1 else 0) * self.base + own[end]
                shift[key] = min(shift.get(key, size), max(0, size - 1 - end))  # words that the first window has after it
        counts = np.array([n - size + 1 for _, n, _ in spans])
        begins = np.repeat(np.array([first for first, _, _ in spans]) - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owner = np.repeat(np.array([o for _, _, o in spans]), counts)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, size)[begins])
        _, kept, window = np.unique(rows.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([window.ravel(), owner], 1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        edges = np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))
        buckets: dict[int, list[int]] = defaultdict(list)
        before = rows[kept, -2].tolist() if size > 1 else [0] * len(kept)
        for number, (x, y) in enumerate(zip(before, rows[kept, -1].tolist())):
            buckets[x * self.base + y].append(number)
        return shift, dict(buckets), begins[kept].tolist(), (edges, pairs[:, 1])

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items that own these windows."""
        hit, found = np.zeros(len(words), bool), []
        ids, base, own = self.ids.get, self.base, self.words
        for size, shift, buckets, begins, (edges, owners) in self.groups:
            seen_windows = set()
            end, n, step = size - 1, len(words), max(1, size - 1)
            while end < n:
                last = ids(words[end])
                if last is None:
                    end += size
                    continue
                before = ids(words[end - 1]) if size > 1 else 0
                if before is None:
                    end += step
                    continue
                move = shift.get(before * base + last, step)
                if move:
                    end += move
                    continue
                start = end - size + 1
                seen = words[start : end + 1]
                for number in buckets.get(before * base + last, ()):
                    at = begins[number]
                    if own[at : at + size] == seen:
                        hit[start : end + 1] = True
                        seen_windows.add(number)
                        break  # windows are distinct
                end += 1
            found += [owners[edges[number] : edges[number + 1]] for number in seen_windows]
        return hit, {self.names[i] for i in np.unique(np.concatenate(found)).tolist()} if found else set()


def _spans(hit: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges.astype(np.int32).tolist()


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with the struct column ``found``: n_words, hits, items; it replaces a column of that name.

    ``hits`` lists starts and ends (exclusive) of the maximal runs of words inside windows, in words;
    ``items`` the item ids as text, sorted. ``items`` of the argument are rows (item_id, text).

    Defined results: a null or empty text has no words. An item of fewer words than a window is one
    window, an item without words is none. Items that share an id are one item; windows of an item
    without id are searched and hit, but it is not listed. Whole texts are read, copies each on their own.
    """
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)
    queries = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))

    def block(k: int) -> list[tuple]:
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        return list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))

    others = without(docs, "found")
    if blocks == 1:
        return docs.select(*others, _search(spark, block(0), window)(quoted(text_col)).alias("found"))
    # The rows are written once, under a number; each block reads numbers and texts and keeps what it hits.
    numbered = stored(docs.select(F.struct(*others).alias("row"), F.monotonically_increasing_id().alias("number")))
    text = F.col("row").getField(text_col)
    parts = []
    for k in range(blocks):
        part = numbered.select("number", _search(spark, block(k), window)(text).alias("found")).where(F.size("found.hits") > 0)
        parts.append(stored(part.select("number", "found.hits", "found.items")))
    hit = reduce(DataFrame.unionByName, parts).groupBy("number").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    hit = stored(hit)
    listed = Bitmap(hit.select(F.xxhash64("number")))
    some = F.arrow_udf(lambda place, text: _counted(listed, place, text), "may boolean, n_words bigint")
    marked = numbered.select("row", "number", some(F.xxhash64("number"), text).alias("m"))
    nothing = F.struct("m.n_words", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    clean = marked.where("NOT m.may").select("row.*", nothing.alias("found"))
    runs = F.arrow_udf(_merged, "array<int>")(F.col("hits"))
    named = F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>"))
    found = F.struct("m.n_words", F.coalesce("runs", F.array().cast("array<int>")).alias("hits"), named.alias("items"))
    merged = hit.select("number", runs.alias("runs"), "items")
    # texts are not needed any more; rows that no block hits stay where they are
    return clean.unionByName(marked.where("m.may").join(merged, "number", "left").select("row.*", found.alias("found")))


def _counted(listed: Bitmap, place: pa.Array, text: pa.Array) -> pa.Array:
    may = pa.array(listed.may_hold(place.to_numpy()))
    counts = [len(words_of(body.as_py())) for body in text]
    return pa.StructArray.from_arrays([may, pa.array(counts, pa.int64())], ["may", "n_words"])


def _merged(hits: pa.Array) -> pa.Array:
    """Maximal runs of each row's lists of runs."""
    result = []
    for lists in hits.to_pylist():
        runs = sorted(run for found in lists for run in zip(found[::2], found[1::2]))
        joined = []
        for start, end in runs:
            if joined and start <= joined[-1]:
                joined[-1] = max(joined[-1], end)
            else:
                joined += [start, end]
        result.append(joined)
    return pa.array(result, pa.list_(pa.int32()))


def _search(spark: SparkSession, rows: list[tuple], window: int):
    """Column function from a text to n_words, hits and items of one block of the benchmark."""
    held = spark.sparkContext.broadcast((rows, window))
    key = f"decontaminate {uuid.uuid4().hex}"

    @F.arrow_udf(_FOUND)
    def search(text: pa.Array) -> pa.Array:
        patterns = held_by_worker(key, lambda: Patterns(*held.value))
        result = []
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], "text"):
            for body in part.column("text"):
                words = words_of(body.as_py())
                hit, names = patterns.search(words)
                result.append({"n_words": len(words), "hits": _spans(hit), "items": sorted(names)})
        return pa.array(result, _ARROW)

    return search


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items).select("doc_id", "found.*")
    places = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    n_hit = F.aggregate(places, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lens AS (SELECT DISTINCT least(len(w), 10) AS m FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)
), h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)
), hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM h) GROUP BY 1
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
