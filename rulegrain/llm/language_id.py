"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams inside each input partition in numpy and adds the counts up with a hash
aggregate, so a label that a third of all rows carry sends one row per bucket and partition. The
log-probabilities of ``BLOCK`` labels at a time form a matrix, which is bounded (``BLOCK`` times
``BUCKETS`` floats, 8 MB at most) and broadcast. Scoring takes a batch of texts at a time through all
matrices, one after the other, so that any number of labels counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import stored
from .common import crc_of_id, prepare_workers, quoted, slices, without

BITS = 15
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Labels whose counts or weights are held as dense rows at a time.
BLOCK = 64
#: Matrices that a worker keeps; if there are more, each is read again for each batch.
KEPT_BLOCKS = 16
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash, one per place of a character.
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
_SLICE = 1_000_000


@dataclass(frozen=True)
class Model:
    """``blocks`` have a row per language, in order; their last column is for n-grams that do not count."""

    languages: tuple[str, ...]
    priors: np.ndarray
    blocks: tuple[Broadcast, ...]

    def weights(self) -> Iterator[np.ndarray]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > KEPT_BLOCKS and getattr(block, "_path", None):
                block.__dict__.pop("_value", None)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _gram_buckets(texts: list[str]) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each place of all texts, order by order; where each text starts; its letters.

    What is not a letter is a space, and each text stands between two. N-grams with two spaces side by side do
    not count, which also keeps them from reaching over into the next text.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    n_letters = np.add.reduceat(letter, starts, dtype=np.int64)

    def orders() -> Iterator[np.ndarray]:
        for n in ORDERS:
            size = len(codes) - n + 1
            mixed = np.full(size, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
            counts = letter[:size].copy()
            for i in range(n):
                mixed ^= codes[i : i + size] * _FACTORS[i]
                mixed *= np.uint32(0x2C1B3C6D)
                mixed ^= mixed >> np.uint32(13)
                if i:
                    counts |= letter[i : i + size]
            for i in range(n - 1):
                counts &= letter[i : i + size] | letter[i + 1 : i + 1 + size]
            buckets = np.full(len(codes), BUCKETS, np.int32)
            buckets[:size] = np.where(counts, (mixed >> np.uint32(32 - BITS)).astype(np.int32), BUCKETS)
            yield buckets

    return orders(), starts, n_letters


def _slice_counts(texts: list[str], langs: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Each label with its counts, at most BLOCK labels at a time; the last count is of documents."""
    names = iter(sorted(set(langs)))
    while some := {name: i for i, name in enumerate(islice(names, BLOCK))}:
        chosen = [i for i, x in enumerate(langs) if x in some]
        codes = np.array([some[langs[i]] for i in chosen], np.int64)
        orders, starts, _ = _gram_buckets([texts[i] for i in chosen])
        of_place, total = None, np.zeros(len(some) * (BUCKETS + 1), np.int64)
        for buckets in orders:
            if of_place is None:
                of_place = np.repeat(codes * (BUCKETS + 1), np.diff(starts, append=len(buckets)))
            total += np.bincount(of_place + buckets, minlength=len(total))
        rows = total.reshape(len(some), BUCKETS + 1)
        rows[:, BUCKETS] = np.bincount(codes, minlength=len(some))
        yield from zip(some, rows)


def _count_rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, row in held.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(some), pa.string()),
                pa.array(np.where(some == BUCKETS, -1, some), pa.int32()),
                pa.array(row[some], pa.int64()),
            ],
            names=["lang", "bucket", "n"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) of one partition, a label's counts in one or several; bucket -1 counts documents."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", _SLICE):
        for name, row in _slice_counts(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            if name not in held and len(held) >= BLOCK:
                yield from _count_rows(held)
                held = {}
            held[name] = held.get(name, 0) + row
    yield from _count_rows(held)


def _weights(counts: DataFrame, names: list[str], smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the n-grams of some labels, and their numbers of documents."""
    weights, place = np.zeros((len(names), BUCKETS + 1)), {name: i for i, name in enumerate(names)}
    found = counts.toArrow()
    at = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    weights[at, found.column("bucket").to_numpy()] = found.column("n").to_numpy()  # bucket -1 is the last column
    docs = weights[:, BUCKETS].copy()
    weights[:, BUCKETS] = 0
    counted = weights[:, :BUCKETS]
    weights[:, :BUCKETS] = np.log((counted + smoothing) / (counted.sum(1, keepdims=True) + smoothing * BUCKETS))
    return weights.astype(np.float32), docs


def fit(rows: DataFrame, smoothing: float = 0.5, max_languages: int | None = None) -> Model:
    """A model from rows (text, lang); rows without either are left out, no rows give an empty model.

    All rows and labels are counted. More than ``max_languages`` distinct labels, if given, raise ValueError.
    """
    rows = rows.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    distinct = rows.select("lang").distinct()
    names = sorted(r[0] for r in (distinct if max_languages is None else distinct.limit(max_languages + 1)).collect())
    if max_languages is not None and len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    spark = rows.sparkSession
    prepare_workers(spark)
    counts = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(names) > BLOCK:
        counts = stored(counts)
    blocks, docs = [], np.zeros(0)
    for at in range(0, len(names), BLOCK):
        some = names[at : at + BLOCK]
        mine = counts.where(F.col("lang").isin(some)) if len(names) > BLOCK else counts
        weights, found = _weights(mine, some, smoothing)
        blocks.append(spark.sparkContext.broadcast(weights))
        docs = np.append(docs, found)
    priors = np.log(np.maximum(docs, 1) / max(docs.sum(), 1))
    return Model(tuple(names), priors, tuple(blocks))


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most likely language and its posterior probability of each text."""
    filled = [t or "" for t in texts]
    if not filled or not model.languages:
        return [UNKNOWN] * len(filled), [0.0] * len(filled)
    best, top, odds = np.zeros(len(filled), np.int64), np.full(len(filled), -np.inf), np.zeros(len(filled))
    first = 0
    for weights in model.weights():
        orders, starts, letters = _gram_buckets(filled)
        sums = np.tile(model.priors[first : first + len(weights)], (len(filled), 1))
        for buckets in orders:
            for k, row in enumerate(weights):
                sums[:, k] += np.add.reduceat(row[buckets], starts, dtype=np.float64)
        higher = np.maximum(top, sums.max(1))
        best = np.where(higher > top, first + sums.argmax(1), best)
        odds = odds * np.exp(top - higher) + np.exp(sums - higher[:, None]).sum(1)
        top = higher
        first += len(weights)
    score = np.where(letters > 0, 1 / odds, 0.0)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best, letters)], score.tolist()


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1), which replace columns of these names.

    Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
    text under a model without languages. Whole texts are read. Rows stay where they are: no shuffle.
    """
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)

    @F.arrow_udf("lang_pred string, lang_score double")
    def scored(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], "text", _SLICE):
            found = predict_texts(model, part.column("text").to_pylist())
            langs += found[0]
            scores += found[1]
        fields = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(fields, ["lang_pred", "lang_score"])

    kept = without(docs, "lang_pred", "lang_score")
    return docs.select(*kept, scored(quoted(text_col)).alias("__found")).select(
        *without(docs, "lang_pred", "lang_score"), "__found.*"
    )


def fit_held_out(docs: DataFrame) -> Model:
    """The model of all documents but those held out, whose CRC of the id leaves 1 when divided by 3."""
    return fit(docs.where(crc_of_id("doc_id") % 3 != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), fit_held_out(docs))
    held_out = (crc_of_id("doc_id") % 3 == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))
