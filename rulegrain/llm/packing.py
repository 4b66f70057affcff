"""Order-preserving packing of token streams by dynamic programming.

The documents of an input partition, in their order, form one token stream. Cuts may fall after a
document (free), after a sentence (a small penalty, as it truncates the document) or at a grid of
places (a larger one). The programme chooses the cuts that minimise padding plus penalties:

    best(j) = min over i with place(j) - place(i) <= size of best(i) + padding(place(j) - place(i)) + penalty(j)

Padding falls by one with each token, so best(i) + place(i) decides between all i in reach, and a
queue whose values only rise keeps the smallest at its head: each place enters and leaves it once.
Sequences whose length is a power of two need no padding; they take the rest at a partition's end.

No shuffle: a partition is packed where it is read, in pieces of about ``CHUNK`` tokens with the
last sequences carried over, and a task that is run again gives the same sequences.
"""

from __future__ import annotations

import re
import string
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import from_scratch, prepare_workers, quoted, slices

SIZE = 2048
END_ID = 1
CHUNK = 500_000
#: Bytes of text whose words are numbered at a time; cuts are looked for after four times as many.
SLICE = 250_000
GRID = 128
#: In tokens of padding: what a sequence more costs, a cut after a sentence, a cut anywhere else.
SEQUENCE_COST, SENTENCE_PENALTY, HARD_PENALTY = 64, 4, 24
#: Distinct words a worker remembers before it drops the newer half.
MAX_WORDS = 300_000
#: After a word of letters, a row of these is a piece of its own; rows of up to four are remembered.
_MARKS = string.punctuation


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies, where it is not the byte's own."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in shown), range(256, 512)))


class WordTokenizer(dict):
    """Number of each word seen; the ids of word i are ``flat[starts[i] : starts[i] + sizes[i]]``.

    The vocabulary's pieces never reach over white space, so that a text's ids are its words' ids in a
    row. Words of letters with punctuation after them go to the BPE model as two pieces, as its
    splitting rule has it; all others take the tokenizer's whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.clear()

    def clear(self) -> None:
        super().clear()
        #: Ids of rows of marks.
        self.marks: dict[str, list[int]] = {}
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("i")
        self._add([None], [END_ID], [1])

    def _forget(self) -> None:
        """Drop all words but the older half of those it may hold: frequent words are met early."""
        kept = dict(islice(self.items(), MAX_WORDS // 2))
        super().clear()
        self.update(kept)
        self.marks.clear()
        del self.flat[self.starts[len(kept)] :], self.starts[len(kept) :], self.sizes[len(kept) :]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, text: str) -> list[int]:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self, new: list[bytes]) -> None:
        """Number words not seen before, all of a slice at once: most of packing's time is spent on them."""
        tokenize, known, flat, sizes = self.model.tokenize, self.marks, [], []
        # words hold no white space, so that one decoding serves all
        for text in b"\n".join(new).decode("utf-8", "replace").split("\n"):
            before = len(flat)
            body = text.rstrip(_MARKS)
            marks = text[len(body) :]
            if not body.isalpha() or len(marks) > 4:
                flat += self._ids(text)
            elif text.isascii():
                flat += [t.id for t in tokenize(body.lower())]
                if marks:
                    flat += known.get(marks) or known.setdefault(marks, self._piece(marks))
            elif "Σ" not in body and unicodedata.is_normalized("NFC", body) and (lower := body.lower()).isalpha():
                flat += self._piece(lower)
                if marks:
                    flat += known.get(marks) or known.setdefault(marks, self._piece(marks))
            else:
                flat += self._ids(text)
            sizes.append(len(flat) - before)
        self._add(new, flat, sizes)

    def _add(self, words: list[bytes | None], flat: list[int], sizes: list[int]) -> None:
        self.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes).tobytes())
        self.sizes.extend(sizes)
        self.flat.extend(flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's closed by END_ID, and the number of each text's ids."""
        if len(self) > MAX_WORDS:
            self._forget()
        words: list[bytes | None] = []
        firsts = []
        for text in texts:
            firsts.append(len(words))
            words += (text or "").encode("utf-8", "replace").split()
            words.append(None)
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        if len(missed := np.flatnonzero(numbers < 0)):
            new = [words[i] for i in missed.tolist()]
            self._learn(list(dict.fromkeys(new)))
            numbers[missed] = np.fromiter(map(self.__getitem__, new), np.int64, len(new))
        # views of the tables, not copies: they are let go before the tables grow again
        sizes = np.frombuffer(self.sizes, np.int32)[numbers].astype(np.int64)
        starts = np.frombuffer(self.starts, np.int64)[numbers]
        before = np.cumsum(sizes) - sizes
        places = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        return np.frombuffer(self.flat, np.uint32)[places], np.add.reduceat(sizes, firsts)


def _sentence_ends(words: WordTokenizer) -> np.ndarray:
    """For each id, whether its piece is punctuation that ends a sentence."""
    vocab = words.tokenizer.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for piece, number in vocab.items():
        body = piece.removesuffix("</w>")
        ends[number] = piece != body and bool(re.fullmatch(r"[.!?]+[\"')\]]*", body))
    return ends


def _tables(path: str) -> tuple[WordTokenizer, np.ndarray]:
    words = WordTokenizer(path)
    return words, _sentence_ends(words)


def choose_cuts(places: np.ndarray, penalties: np.ndarray, final: bool, size: int = SIZE) -> list[int]:
    """Ends of the sequences that cost least; ``places`` rise from 0, and no two are more than ``size`` apart."""
    spots, fines = places.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}
    if final:  # sequences without padding, for the rest
        near = np.flatnonzero(places >= places[-1] - 2 * size)
        power = 1
        while power < size:
            at = np.minimum(np.searchsorted(places, places[near] - power), len(places) - 1)
            for j, i in zip(near[places[at] == places[near] - power].tolist(), at[places[at] == places[near] - power].tolist()):
                exact.setdefault(j, []).append(i)
            power *= 2
    best, back = [0] * len(spots), [0] * len(spots)
    queue, values, head = [0], [0], 0
    for j in range(1, len(spots)):
        spot = spots[j]
        while spots[queue[head]] < spot - size:
            head += 1
        cost, via = values[head] + size - spot, queue[head]
        for i in exact.get(j, ()):
            if best[i] < cost:
                cost, via = best[i], i
        best[j], back[j] = cost + fines[j] + SEQUENCE_COST, via
        value = best[j] + spot
        while len(values) > head and values[-1] >= value:
            values.pop()
            queue.pop()
        values.append(value)
        queue.append(j)
    cuts, j = [], len(spots) - 1
    while j > 0:
        cuts.append(spots[j])
        j = back[j]
    return cuts[::-1]


def _candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    total = len(ids)
    penalties = np.full(total + 1, -1, np.int16)
    penalties[::GRID] = HARD_PENALTY
    if final:
        penalties[max(0, total - SIZE) :] = HARD_PENALTY
    penalties[1:][ends[np.minimum(ids, len(ends) - 1)]] = SENTENCE_PENALTY
    penalties[doc_ends] = 0
    penalties[0] = penalties[total] = 0
    places = np.flatnonzero(penalties >= 0)
    return places, penalties[places]


class _Stream:
    """Tokens of one partition that no sequence has taken yet, and the documents they belong to."""

    def __init__(self, ends: np.ndarray, first: int) -> None:
        self.ends, self.sequence = ends, first
        self.ids, self.names = np.zeros(0, np.uint32), []
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray, names: list) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.names = self.names + names
        self.ids = np.concatenate([self.ids, ids])

    def take(self, final: bool) -> pa.RecordBatch | None:
        """Pieces of the sequences chosen; but for the final call the last two stay open."""
        if not len(self.ids):
            return None
        doc_ends = self.starts + self.sizes
        places, penalties = _candidates(self.ids, doc_ends, self.ends, final)
        cuts = np.array(choose_cuts(places, penalties, final), np.int64)
        cuts = cuts if final else cuts[:-2]
        if not len(cuts):
            return None
        taken = int(cuts[-1])
        edges = np.unique(np.concatenate([[0], doc_ends[doc_ends < taken], cuts]))
        a, b = edges[:-1], edges[1:]
        doc, window = np.searchsorted(doc_ends, a, "right"), np.searchsorted(cuts, a, "right")
        window_starts = np.concatenate([[0], cuts[:-1]])
        data = self.ids.astype("<u4", copy=False)
        columns = [
            pa.array([self.names[d] for d in doc.tolist()], pa.int64()),
            pa.array(a - self.starts[doc]),
            pa.array(b - a),
            pa.array(self.sizes[doc]),
            pa.array(self.sequence + window),
            pa.array(a - window_starts[window]),
            pa.array([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
        ]
        self.sequence += len(cuts)
        left = int(np.searchsorted(doc_ends, taken, "right"))
        self.ids, self.names = self.ids[taken:], self.names[left:]
        self.starts, self.sizes = self.starts[left:] - taken, self.sizes[left:]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's token ids as little-endian 32-bit numbers; ``tokenizer`` is the path of
    a vocabulary file that every worker has. ``sequence_id`` counts within a partition and has the
    partition's number above bit 32.

    Defined results: a null or empty text is its closing id only. Every row is packed, rows that repeat
    or have a null id too. An empty table has no sequences; other columns are not read.
    """
    prepare_workers(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends = _tables(tokenizer)
        stream = _Stream(ends, TaskContext.get().partitionId() << 32)
        for batch in slices(batches, "text", 4 * SLICE):
            for part in slices(iter([batch]), "text", SLICE):
                ids, sizes = words.encode(part.column("text").to_pylist())
                stream.add(ids, sizes, part.column("doc_id").to_pylist())
            if len(stream.ids) >= CHUNK and (out := stream.take(False)):
                yield out
        if out := stream.take(True):
            yield out

    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(text_col).alias("text"))
    # a worker that waits for its turn holds no tables
    return rows.mapInArrow(from_scratch(packed), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
