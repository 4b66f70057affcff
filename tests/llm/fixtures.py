"""Small tables, and slow but plain versions of what the operators do."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": DOCUMENTS,
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
#: Names that operators use inside, as extra columns of their input.
CLASHING = ["key", "node", "found", "lang_pred", "document", "start", "end", "hash", "kind", "n", "sig", "spans", "salt", "rows", "place"]


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src0", None if text is None else len(text))


def edge_documents() -> list[tuple]:
    """Nulls in all columns, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    same = words(rng, 200)
    texts = [None, "", " \t\n", "a", "12345 --- 678", same, same, same + " tail", long, long, "é ß ñ 中文 \U0001f600", "x" * 30_000]
    rows = [document(i, t) for i, t in enumerate(texts)]
    rows += [document(5, same), document(5, same), document(None, same), document(None, None), document(None, "left over words here")]
    return rows + [(None, None, None, None, None)]


def folder(spark: SparkSession, path, **tables) -> str:
    """A folder with all tables; those not given are empty."""
    for name, schema in TABLES.items():
        spark.createDataFrame(tables.get(name, []), schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def with_clashes(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("*", *[f"'{name}' AS `{name}`" for name in CLASHING])


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def shingles(text: str | None) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def linked(texts: list[str | None]) -> list[int]:
    """For each text the number of its component under a Jaccard similarity of 0.8."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def without_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """Bytes, removed bytes, removed runs and digest of the rest of each text."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    result = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        result.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return result


def windows_hit(text: str | None, items: list[tuple], size: int = 10) -> tuple[int, int, list[str]]:
    """Words, words inside windows, and items with windows in the text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, names = split(text), set(), set()
    for name, body in items:
        there = split(body)
        m = min(size, len(there))
        wanted = {tuple(there[i : i + m]) for i in range(len(there) - m + 1)} if m else set()
        for i in range(len(own) - m + 1 if m else 0):
            if tuple(own[i : i + m]) in wanted:
                hit.update(range(i, i + m))
                if name is not None:
                    names.add(str(name))
    return len(own), len(hit), sorted(names)
