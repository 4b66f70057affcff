"""Near copies by chosen paths, hard negatives, and Merkle proofs, against SQL and plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.llm import chosen_path, hard_negatives, merkle

from .fixtures import DOCUMENTS, document, edge_documents, folder, rows_of, with_clashes, words

VECTORS = "vec_id bigint, embedding array<float>, label int"


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


def ours(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows_of(df)), key=repr)


def plain_components(texts, threshold=85, size=3):
    sets = []
    for t in texts:
        found = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set())
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= threshold * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root, [len(s) for s in sets]
    return root, [len(s) for s in sets]


def near_texts(seed=1):
    """Chains of copies, sets at the threshold, and many texts that share a passage but are not similar."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = words(rng, rng.randrange(60, 160)).split()
        for _ in range(8):
            texts.append(" ".join(base))
            base = list(base)
            base[rng.randrange(len(base))] = f"x{rng.randrange(1000)}"
    passage = words(rng, 60)
    texts += [passage + " " + words(rng, rng.randrange(30, 60)) for _ in range(60)]
    texts += ["a b c d e f", "a b c d e f g", "A B", "a b", "a", None, "", "  "]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("node", [chosen_path.NODE, 8])
def test_chosen_paths_agree_with_brute_force(spark, node):
    """Nodes inside tasks, and nodes that move on to the next round set by set."""
    texts = near_texts()
    docs = with_clashes(spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCUMENTS))
    found = {r["doc_id"]: r for r in rows_of(chosen_path.near_copies(docs, node=node))}
    roots, sizes = plain_components(texts)
    assert [found[i]["component_id"] for i in range(len(texts))] == roots
    assert [found[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_branches_inside_a_node_lose_no_pair(monkeypatch):
    """A node of many strangers and some near-copies, with small leaves: recall over trees, none but similar pairs."""
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 2**62, 30).astype(np.uint64)
    sets = []
    for _ in range(300):
        own = np.concatenate([shared, rng.integers(1, 2**62, 120).astype(np.uint64)])
        sets += [np.sort(own), np.sort(np.concatenate([own[:-5], rng.integers(1, 2**62, 5).astype(np.uint64)]))]
    made, _ = chosen_path.sketches(sets)
    table = chosen_path.pa.table(
        {"sketch": [m.tobytes() for m in made], "number": np.arange(600), "root": np.arange(600), "n": np.full(600, 150, np.int32)}
    )
    node = chosen_path.Sketches(table)
    found = set()
    for path in range(chosen_path.TREES):
        for a, b in chosen_path._branch(node, np.arange(600), path + 1):
            found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert found == {(2 * i, 2 * i + 1) for i in range(300)}


def test_trees_reach_the_recall():
    p = chosen_path.survival(0.85)
    assert 0.8 < p < 0.85 and 1 - (1 - p) ** chosen_path.TREES >= chosen_path.RECALL


def test_near_copies_of_edge_documents(spark):
    rows = edge_documents()
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = rows_of(chosen_path.near_copies(docs))
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert [by_id[i]["component_id"] for i in (0, 1, 2, 5, 6, 7, 8, 9)] == [0, 1, 2, 5, 5, 5, 8, 8]
    assert [by_id[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and not by_id[6]["kept"]
    assert rows_of(chosen_path.near_copies(docs.limit(0))) == []
    named = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {r["component_id"] for r in rows_of(chosen_path.near_copies(named)) if r["doc_id"] in ("id5", "id6", "id7")} == {"id5"}


def vector_rows(n=400, width=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[50][1], rows[50][2] + (i % 2)) for i in range(40)]  # ties
    nan, inf = float("nan"), float("inf")
    rows += [(5000, None, 1), (5050, [1.0, None, 0.0], 1), (5100, [nan] * width, 1), (5150, [inf] * width, 1), (5200, [0.5] * width, None)]
    return rows + [(5250, [], 2), (5300, [0.25], 2), (5350, [0.0] * width, 2), (None, [0.5] * width, 1), (50, rows[50][1], rows[50][2])]


@pytest.mark.parametrize("codes,shard,seed_rows", [(32, 8192, 2048), (4, 16, 5), (8, 100, 1)])
def test_hard_negatives_agree_with_a_plain_search(spark, codes, shard, seed_rows):
    rows = vector_rows()
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'a' AS anchor", "'s' AS shard", "'v' AS v", "'c' AS cell")
    found = hard_negatives.hard_negatives(table, F.col("vec_id") % 50 == 0, codes=codes, shard_rows=shard, seed_rows=seed_rows)
    usable = {}
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[vec_id] = (label, [int(np.floor(256 * float(x))) for x in v])
    expected = []
    for a, (label, v) in usable.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in usable.items() if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            expected += [(a, i, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(fits)]
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ours(found, columns) == sorted(expected, key=repr) and len(expected) > 50


def test_hard_negatives_agree_with_sql_and_of_nothing(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ours(hard_negatives.query(spark, sf), columns) == sql_rows(hard_negatives.ORACLE, columns, embeddings=f"{sf}/embeddings.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    nothing = hard_negatives.query(spark, str(tmp_path))
    assert nothing.columns == columns and nothing.count() == 0


def test_heap_visits_every_cell_once_in_falling_order():
    rng = np.random.default_rng(1)
    halves = [(rng.normal(size=n), np.abs(rng.normal(size=n))) for n in (5, 7)]
    seen = list(hard_negatives.visits(*halves))
    assert [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True)
    assert len({s[2:] for s in seen}) == 35
    for upper, lower, i, j in seen:
        assert np.isclose(upper, halves[0][0][i] + halves[0][1][i] + halves[1][0][j] + halves[1][1][j])
        assert np.isclose(lower, halves[0][0][i] - halves[0][1][i] + halves[1][0][j] - halves[1][1][j])


def test_sums_beyond_doubles_are_exact():
    big = np.array([[2.0**40, 1.0], [2.0**40, 3.0]])
    assert hard_negatives._products(big, big).tolist() == [[2**80 + 1, 2**80 + 3], [2**80 + 3, 2**80 + 9]]


def plain_manifest(rows):
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    frame = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, text, lang, source, n: digest(map(frame, (i, source, lang, n, text)))

    def grown(nodes):
        """Root, and for each node its siblings level by level as (before, after)."""
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, place in enumerate(at):
                run = runs[place // 16]
                proofs[k].append((run[: place % 16], run[place % 16 + 1 :]))
            at, nodes = [p // 16 for p in at], [digest(r) for r in runs]
        return nodes[0], proofs

    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        members = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (members, *grown([leaf(*r) for r in members]))
    root, above = grown([trees[s][1] for s in sources])
    found = []
    for s, upper in zip(sources, above):
        members, subroot, proofs = trees[s]
        for row, proof in zip(members, proofs):
            i, text, lang, source, n = row
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
            node = leaf(i, low if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text, lang, source, n)
            for before, after in proof + upper:
                node = digest([*before, node, *after])
            siblings = [x for before, after in proof + upper for x in [*before, *after]]
            found.append((i, leaf(*row), subroot, root, digest(siblings), node, node == root))
    return found


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows():
    rng = random.Random(9)
    rows = [(i, rng.choice(["Some Text", "lower", "", None, "É Ü x"]) and f"Text {i}", "en", f"s{min(int(rng.expovariate(0.3)), 40)}", i) for i in range(900)]
    rows += [(i, None if i % 3 else "", None, rng.choice([None, "", "é", "Z", "a"]), None) for i in range(900, 960)]
    return rows + edge_documents()


@pytest.mark.parametrize("climb", [3, 1])
def test_manifest_agrees_with_a_plain_version(spark, tmp_path, climb):
    """Trees inside one block, and trees that take several rounds."""
    rows = manifest_rows()
    there = folder(spark, tmp_path, documents=rows)
    found = ours(merkle.tampered(spark.read.parquet(f"{there}/documents.parquet"), climb), MANIFEST)
    assert found == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in found} == {True, False}
    assert found == sql_rows(merkle.ORACLE, MANIFEST, documents=f"{there}/documents.parquet/*.parquet")


def test_manifest_of_nothing_one_row_and_clashing_columns(spark, tmp_path):
    docs = with_clashes(spark.createDataFrame([document(4, "Abc")], DOCUMENTS)).withColumn("tree", F.lit("t")).withColumn("grp", F.lit(1))
    (row,) = rows_of(merkle.manifest(docs))
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.query(spark, folder(spark, tmp_path)).count() == 0


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([document(i, f"text {i}") for i in range(50)], DOCUMENTS)
    found = rows_of(merkle.manifest(docs, other={"lang": F.when(F.col("doc_id") == 17, "fr").otherwise(F.col("lang"))}))
    assert [r["doc_id"] for r in found if r["folded_root"] != r["root"]] == [17]
