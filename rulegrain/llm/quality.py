"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed where the texts are read. The trees are fitted on a bounded
sample of labelled ids (``MAX_ROWS``), one row of each: the labels of the sample are few enough to be broadcast,
so that fitting shuffles no text. All trees together are five flat arrays, broadcast and walked by numpy for
all rows of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_of_id, prepare_workers, quoted, slices, without

#: Labelled ids the trees are fitted on, with a row each: at most so many are expected, by the hash of the id.
MAX_ROWS = 30_000
BINS, DEPTH, TREES, RATE, PENALTY, LEAST = 64, 5, 80, 0.15, 1.0, 10
BLOCK_WORDS = 50
_SYMBOLS = b"#$%&*@^~=+<>\\{}[]_"

FEATURES = (
    "log_bytes", "log_words", "letters", "upper", "digits", "exclamations", "bars", "symbols", "newlines", "commas",
    "periods", "spaces", "word_length", "distinct_words", "top_word", "repeated_neighbours", "distinct_lines",
    "least_distinct_block", "most_marked_block", "marked_words", "capital_words", "non_ascii",
)


def _byte_counts(texts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.repeat(np.arange(len(texts)) * 256, sizes) + data
    return np.bincount(place, minlength=256 * len(texts)).reshape(len(texts), 256).astype(np.float64)


def _word_statistics(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    marked = [not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",") for w in words]
    blocks = range(0, n, BLOCK_WORDS)
    least = min(len(set(words[b : b + BLOCK_WORDS])) / len(words[b : b + BLOCK_WORDS]) for b in blocks)
    most = max(sum(marked[b : b + BLOCK_WORDS]) / len(marked[b : b + BLOCK_WORDS]) for b in blocks)
    return [
        n, len(counts) / n, max(counts.values()) / n, same / n, len(set(lines)) / max(1, len(lines)),
        least, most, sum(marked) / n, sum(map(bytes.isupper, words)) / n,
    ]


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; null counts as empty."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    if not data:
        return np.zeros((0, len(FEATURES)))
    counts = _byte_counts(data)
    size = counts.sum(1)
    share = lambda x: x / np.maximum(size, 1)
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    other = counts[:, 128:].sum(1)
    words = np.array([_word_statistics(t) for t in data])
    spaces = counts[:, [9, 10, 11, 12, 13, 32]].sum(1)
    each = lambda code: counts[:, code] / np.maximum(words[:, 0], 1)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words[:, 0]), share(upper + lower + other), upper / np.maximum(upper + lower, 1),
            share(counts[:, 48:58].sum(1)), each(33), each(124), share(counts[:, list(_SYMBOLS)].sum(1)), each(10), each(44),
            each(46), share(spaces), (size - spaces) / np.maximum(words[:, 0], 1), words[:, 1:], share(other),
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in a row; a leaf's children are itself. ``roots`` says where each tree begins."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total, at = np.full(len(rows), self.base), np.arange(len(rows))
        for root in self.roots.tolist():
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                smaller = rows[at, self.feature[node]] <= self.threshold[node]
                node = np.where(smaller, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _grow(codes, edges, gradient, hessian, nodes: dict[str, list]) -> np.ndarray:
    """One tree, level by level, from histograms of all its open nodes at once; the step of each row."""
    n, width = codes.shape[0], len(edges)
    flat = codes + np.arange(width) * BINS
    first = len(nodes["value"])

    def leaf(g: float, h: float) -> int:
        at = len(nodes["value"])
        for key, value in zip(("feature", "threshold", "left", "right", "value"), (0, 0.0, at, at, -RATE * g / (h + PENALTY))):
            nodes[key].append(value)
        return at

    place = np.full(n, leaf(gradient.sum(), hessian.sum()))
    open_nodes = [first]
    for _ in range(DEPTH):
        number = np.full(len(nodes["value"]), -1)
        number[open_nodes] = np.arange(len(open_nodes))
        rows = np.flatnonzero(number[place] >= 0)
        key = (number[place[rows]][:, None] * (width * BINS) + flat[rows]).ravel()
        shape = (len(open_nodes), width, BINS)
        sums = [
            np.bincount(key, np.repeat(x[rows], width) if x is not None else None, minlength=np.prod(shape)).reshape(shape).cumsum(2)
            for x in (gradient, hessian, None)
        ]
        whole = [x[:, :, -1:] for x in sums]
        gain = lambda g, h: g * g / (h + PENALTY)
        value = gain(sums[0], sums[1]) + gain(whole[0] - sums[0], whole[1] - sums[1]) - gain(whole[0], whole[1])
        value[(sums[2] < LEAST) | (whole[2] - sums[2] < LEAST)] = -1
        following = []
        for i, node in enumerate(open_nodes):
            best = int(value[i].argmax())
            feature, code = divmod(best, BINS)
            if value[i].flat[best] <= 1e-9:
                continue
            g, h = sums[0][i, feature, code], sums[1][i, feature, code]
            left, right = leaf(g, h), leaf(whole[0][i, 0, 0] - g, whole[1][i, 0, 0] - h)
            nodes["feature"][node], nodes["threshold"][node] = feature, edges[feature][code]
            nodes["left"][node], nodes["right"][node] = left, right
            mine = rows[place[rows] == node]
            place[mine] = np.where(codes[mine, feature] <= code, left, right)
            following += [left, right]
        open_nodes = following
        if not open_nodes:
            break
    return np.array(nodes["value"])[place]


def fit_rows(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for label 1 under logistic loss. Without rows of both labels the score is a constant."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {"feature": [0], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0]}
    roots = []
    if 0 < labels.sum() < len(labels):
        # edge b closes bin b: a value is in the first bin whose edge is not below it
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.append(np.quantile(rows[:, f], levels), np.inf) for f in range(rows.shape[1])]
        codes = np.column_stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)])
        total = np.full(len(rows), base)
        for _ in range(TREES):
            chance = 1 / (1 + np.exp(-total))
            roots.append(len(nodes["value"]))
            total += _grow(codes, edges, chance - labels, np.maximum(chance * (1 - chance), 1e-6), nodes)
    ints, floats = (np.array(nodes[k]) for k in ("feature", "left", "right")), (np.array(nodes[k]) for k in ("threshold", "value"))
    feature, left, right = ints
    threshold, value = floats
    return Trees(feature, threshold, left, right, value, np.array(roots, np.int64), base)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Trees from texts (doc_id, text) and labels (doc_id, quality); null labels and ids are left out.

    Where there are more than ``max_rows`` labelled ids, those whose hash falls below a threshold are taken,
    about ``max_rows`` of them, the same ones whatever the order of the rows. An id counts once: with the
    label that most of its rows in ``labels`` have (the good one of equally many), and with the text of
    smallest hash of its rows in ``docs``.
    """
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg((F.col("quality") > 0).cast("int")) >= 0.5).alias("good")
    )
    known = rows.count()
    if known > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / known * (1 << 20)))
    prepare_workers(docs.sparkSession)
    place = F.xxhash64(F.coalesce("text", F.lit(""))).alias("place")
    texts = docs.select("doc_id", "text", place).join(F.broadcast(rows), "doc_id")

    def counted(batches):
        held: dict[int, tuple] = {}
        for batch in slices(batches, "text"):
            taken = {}
            for i, (name, at, good) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "good")))):
                if name not in held or at < held[name][0]:
                    held[name] = (at, good, None)
                    taken[name] = i
            found = statistics([batch.column("text")[i].as_py() for i in taken.values()])
            for name, x in zip(taken, found):
                held[name] = (*held[name][:2], x)
        rows = [(name, *row) for name, row in held.items()]
        for i in range(0, len(rows), 10_000):
            names, places, goods, x = zip(*rows[i : i + 10_000])
            columns = [pa.array(names, pa.int64()), pa.array(places, pa.int64()), pa.array(goods, pa.bool_()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "good", "x"])

    found = texts.select("doc_id", "text", "place", "good").mapInArrow(counted, "doc_id bigint, place bigint, good boolean, x array<double>")
    found = found.groupBy("doc_id").agg(F.first("good").alias("good"), F.min_by("x", "place").alias("x")).toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))[order]
    return fit_rows(x, found.column("good").to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher is better), which replaces a column of that name.

    Defined results: a null text scores as an empty one. Whole texts are read, rows stay where they are.
    """
    prepare_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(text: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([text], ["text"])], "text")
        found = [held.value.score(statistics(p.column("text").to_pylist())) for p in parts]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    udf = F.arrow_udf(scored, "double")
    return docs.select(*without(docs, "quality_score"), udf(quoted(text_col)).alias("quality_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = fit(docs, labels.where(crc_of_id("doc_id") % 5 != 0))
    found = score(docs, trees)
    held_out = (crc_of_id("doc_id") % 5 == 0).alias("held_out")
    predicted = (F.col("quality_score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", held_out, F.col("quality_score").alias("score"), predicted)
