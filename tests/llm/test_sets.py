"""Packing, repeats, exact and near copies, benchmark passages, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rulegrain.llm import components as component_steps, decontaminate, exact_dedup, jaccard_join, packing, suffix_dedup
from rulegrain.llm.components import components
from rulegrain.sources.tables import stored

from .fixtures import DOCUMENTS, document, edge_documents, folder, linked, rows_of, windows_hit, with_clashes, without_repeats, words
from .test_texts import SF, same_as_sql

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("edges") / "t", documents=edge_documents(), benchmark=[(1, "left over words here"), (2, None), (3, "")])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("nothing") / "t")


ODD = ["It's we'll 'S don'T", "ÀÉÎ İstanbul ΑΣ Σ", "Ångström ẖ", "<|endoftext|> x<|startoftext|>y", "a,b.c!? 3.14 $5", "  x​y", "word, word. word!"]


def test_word_ids_are_text_ids():
    words_ = packing.WordTokenizer(TOKENIZER)
    ids, sizes = words_.encode([*ODD, None, ""])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in [*ODD, None, ""]]


def test_new_words_are_numbered_a_slice_at_a_time(monkeypatch):
    """Same ids as the tokenizer's for words of all kinds; the table is asked once for all new words of a slice."""
    rng, calls = random.Random(4), []
    letters = "abZ#*_)ÉéßΣσςİıẖ²Ⅷ١3_.,!?;:'\"$-Åñ日ﬁǅ  "
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(20)) for _ in range(60)]
    words_ = packing.WordTokenizer(TOKENIZER)
    learn = words_._learn
    monkeypatch.setattr(words_, "_learn", lambda new: calls.append(len(new)) or learn(new))
    for _ in range(2):
        ids, sizes = words_.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]
    assert len(calls) == 1 and calls[0] == len(words_) - 1


def test_frequent_words_are_learned_once(monkeypatch):
    """Words met early stay when the table is full; before, all of them had to be looked up again."""
    monkeypatch.setattr(packing, "MAX_WORDS", 40)
    words_, learned = packing.WordTokenizer(TOKENIZER), []
    learn = words_._learn
    monkeypatch.setattr(words_, "_learn", lambda new: learned.extend(new) or learn(new))
    for i in range(12):
        text = f"the same few words, always: {' '.join(f'once{chr(97 + i)}{chr(97 + j)}x.' for j in range(15))}"
        ids, _ = words_.encode([text])
        assert ids.tolist() == ids_of(text) and len(words_) <= 40 + 21
    assert learned.count(b"words,") == 1 and len(learned) == 12 * 15 + 5


def test_pieces_hold_each_id_once(spark, tmp_path):
    rng = random.Random(2)
    texts = [*ODD, *(words(rng, rng.randrange(400)) + ". " + words(rng, rng.randrange(3000)) for _ in range(30)), None, "", ". ".join(["a b c"] * 9000)]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCUMENTS)
    rows = rows_of(with_clashes(docs).transform(lambda d: packing.pack(d, TOKENIZER)))
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        joined = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist()
        assert joined == ids_of(text)
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(joined)}
    padding = total = 0
    for name in {r["sequence_id"] for r in rows}:
        pieces = sorted((r for r in rows if r["sequence_id"] == name), key=lambda r: r["offset"])
        lengths = [r["length"] for r in pieces]
        assert [r["offset"] for r in pieces] == np.cumsum([0] + lengths)[:-1].tolist() and sum(lengths) <= 2048
        total += sum(lengths)
        padding += 0 if sum(lengths).bit_count() == 1 else 2048 - sum(lengths)
    assert padding < 0.02 * total


def test_cuts_cost_least():
    rng = np.random.default_rng(4)
    for final in (False, True):
        for _ in range(20):
            size = 64
            places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 30, 40))]))
            fines = rng.integers(0, 25, len(places))
            cuts = packing.choose_cuts(places, fines, final, size)

            def cost(ends):
                at, total = 0, 0
                for end in ends:
                    n = int(end - at)
                    near = final and at >= 0 and places[-1] - end <= 2 * size
                    total += (0 if n == size or near and n.bit_count() == 1 else size - n) + packing.SEQUENCE_COST + int(fines[np.searchsorted(places, end)])
                    at = end
                return total

            best = {0: (0, [])}
            for end in places[1:].tolist():
                choices = [(cost([*e, end]), [*e, end]) for s, (_, e) in best.items() if 0 < end - s <= size]
                best[end] = min(choices)
            assert cost(cuts) == best[int(places[-1])][0]


def test_packing_edges(spark, edges, nothing):
    rows = rows_of(packing.query(spark, edges))
    wanted = sorted((repr(r[0]), len(ids_of(r[1]))) for r in edge_documents())
    assert sorted((repr(r["doc_id"]), r["doc_tokens"]) for r in rows if r["start"] == 0) == wanted
    piece = next(r for r in rows if r["doc_id"] == 3)
    assert piece["ids_crc32"] == zlib.crc32(np.array(ids_of("a"), "<u4").tobytes())
    assert packing.query(spark, nothing).count() == 0


def repeated_texts():
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [letters(n) for n in (300, 399, 400, 450, 900)]
    texts = [letters(rng.randrange(900)) + rng.choice(passages) + letters(rng.randrange(500)) for _ in range(120)]
    texts += ["abc" * 500, "x" * 1200, "x" * 399, "x" * 400, letters(50) + "xy" * 600 + letters(50)]
    return texts + [texts[0], texts[1], texts[1], None, ""]


@pytest.mark.parametrize("cold", [64, 2])
def test_repeats_agree_with_brute_force(spark, tmp_path, monkeypatch, cold):
    """Sorted in tasks, and counted by parts and windows where an anchor has more kinds of runs than ``cold``."""
    monkeypatch.setattr(suffix_dedup, "COLD", cold)
    texts = repeated_texts()
    there = folder(spark, tmp_path, documents=[document(i, t) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in rows_of(suffix_dedup.query(spark, there))}
    for i, expected in enumerate(without_repeats(texts, 400)):
        assert tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected, i


def test_windows_of_a_repeated_part_are_listed_once(spark, tmp_path, monkeypatch):
    """Two groups of texts share a passage; what the many of one group hold alike is not listed for each of them."""
    monkeypatch.setattr(suffix_dedup, "COLD", 2)
    made = []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, *by: made.append(stored(df, *by)) or made[-1])
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, left, right = letters(500), letters(37), letters(41)
    texts = [letters(300) + left + passage + right + letters(300) for _ in range(60)] + [letters(300) + passage + letters(300) for _ in range(3)]
    docs = spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCUMENTS).repartition(len(texts))
    found = {r["doc_id"]: r for r in rows_of(suffix_dedup.remove_repeats(docs))}
    for i, expected in enumerate(without_repeats(texts, 400)):
        assert tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected, i
    parts = next(m for m in made if m.columns[:4] == ["c1", "c2", "whole", "k1"] and "first" in m.columns)
    windows = next(m for m in made if m.columns[:2] == ["w1", "w2"])
    kinds = {}
    for r in rows_of(parts):
        kinds.setdefault((r["c1"], r["c2"]), {}).setdefault(r["whole"], []).append(r["last"] - r["first"] + 1)
    mixed = [list(k.values()) for k in kinds.values() if len(k) > 1 and min(map(len, k.values())) == 1]
    assert sum(len(n) > 1 for k in mixed for n in k)
    assert 0 < windows.count() <= sum(n[0] for k in mixed for n in k) < sum(sum(n) for k in mixed for n in k)


def test_deep_shallow_order_sorts():
    rng = random.Random(1)
    for _ in range(200):
        stem = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(40)))
        texts = [stem[: rng.randrange(len(stem) + 1)] + bytes(rng.randrange(97, 100) for _ in range(rng.randrange(20))) for _ in range(rng.randrange(1, 30))]
        texts += rng.choices(texts, k=3) + [b""]
        order = suffix_dedup.deep_shallow_order(texts)
        assert sorted(order) == list(range(len(texts))) and [texts[i] for i in order] == sorted(texts)


def test_repeats_edges(spark, edges, nothing):
    rows = rows_of(suffix_dedup.query(spark, edges))
    expected = without_repeats([r[1] for r in edge_documents() if r[1] is None or len(r[1]) < 20_000], 400)
    assert len(rows) == len(edge_documents())
    short = [tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows if r["n_bytes"] < 20_000]
    assert sorted(short) == sorted(expected)
    assert {r["n_removed"] for r in rows if r["n_bytes"] > 100_000} == {max(r["n_bytes"] for r in rows)}
    assert suffix_dedup.query(spark, nothing).count() == 0


def test_exact_copies_agree_with_sql(spark, tmp_path):
    same_as_sql(exact_dedup.query(spark, SF), exact_dedup.ORACLE, SF)
    rows = [document(i, t) for i, t in enumerate(["a b", "a\t b", " a b", "a  b ", "a b ", "", None, " ", "A b", "a b", "\x0b\x0c"])]
    there = folder(spark, tmp_path, documents=rows)
    same_as_sql(exact_dedup.query(spark, there), exact_dedup.ORACLE, there)


def test_texts_of_many_rows_give_the_same_groups(spark, edges, monkeypatch):
    before = sorted(map(repr, rows_of(exact_dedup.query(spark, edges))))
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", 2)
    assert sorted(map(repr, rows_of(exact_dedup.query(spark, edges)))) == before
    there = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    found = rows_of(exact_dedup.exact_groups(there))
    assert len(found) == 3000 and {(r["keep_id"], r["group_size"]) for r in found if r["doc_id"] % 3} == {(1, 2000)}


def test_exact_copies_edges(spark, edges, nothing):
    found = rows_of(exact_dedup.query(spark, edges))
    assert len(found) == len(edge_documents()) and len([r for r in found if r["doc_id"] == 5]) == 3  # a row each
    same = next(r for r in found if r["doc_id"] == 6)
    assert (same["keep_id"], same["group_size"], same["kept"]) == (5, 5, False)
    assert len({r["doc_id"] for r in found if r["kept"]}) == len({r["text_sha256"] for r in found if r["doc_id"] is not None}) + 1
    docs = with_clashes(spark.read.parquet(f"{edges}/documents.parquet"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and len(rows_of(kept)) == len({r["text_sha256"] for r in found})
    assert exact_dedup.query(spark, nothing).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def passages():
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([0, 1, 3, 9, 10, 11, 40]), 60)) for i in range(25)] + [(None, words(rng, 12, 60)), (3, words(rng, 15, 60)), (99, None)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randrange(40), 60)]
        source = rng.choice(items)[1] or ""
        parts.append(" ".join(source.split()[rng.randrange(4) :]).upper().replace(" ", rng.choice([" ", ", ", "\n"])))
        texts.append(" ".join([*parts, words(rng, rng.randrange(30), 60)]))
    return items, [*texts, None, "", "É" + "x" * 100_000]


@pytest.mark.parametrize("block_bytes", [8_000_000, 700])
def test_benchmark_passages_agree_with_brute_force(spark, tmp_path, block_bytes):
    items, texts = passages()
    docs = with_clashes(spark.createDataFrame([document(i, t) for i, t in enumerate(texts)], DOCUMENTS))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {r["doc_id"]: r["found"] for r in rows_of(decontaminate.contamination(docs, table, block_bytes=block_bytes))}
    for i, text in enumerate(texts):
        hits = sum(e - s for s, e in zip(rows[i]["hits"][::2], rows[i]["hits"][1::2]))
        assert (rows[i]["n_words"], hits, rows[i]["items"]) == windows_hit(text, items), i


def test_items_that_share_a_passage_share_its_windows():
    """What a search compares does not grow with the number of items that hold a passage; each of them is listed."""
    rng = random.Random(12)
    passage = words(rng, 30, 60)
    few, many = (decontaminate.Patterns([(str(i), f"item{i} {passage}") for i in range(n)]) for n in (5, 400))
    for n, patterns in ((5, few), (400, many)):
        (_, _, buckets, _, _), = patterns.groups
        assert sum(map(len, buckets.values())) == 21 + n
        hit, names = patterns.search(decontaminate.words_of(f"left {passage} right"))
        assert names == {str(i) for i in range(n)} and hit.sum() == 30 and not hit[0] and not hit[-1]


def test_benchmark_passages_agree_with_sql(spark, tmp_path, nothing, edges):
    same_as_sql(decontaminate.query(spark, SF), decontaminate.ORACLE, SF)
    assert decontaminate.query(spark, nothing).count() == 0
    assert [r["n_items"] for r in rows_of(decontaminate.query(spark, edges)) if r["n_hit"]] == [1]


def near_copies():
    """A group above the bucket's size, a passage in many unlike documents, pairs at the threshold, and small sets."""
    rng = random.Random(13)
    base, passage = words(rng, 150).split(), words(rng, 60)
    texts = []
    for i in range(90):
        one = list(base)
        for _ in range(rng.randrange(4)):
            one[rng.randrange(len(one))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(one))
    texts += [passage + " " + words(rng, rng.randrange(5, 60)) for _ in range(80)]
    for n in (4, 5, 6, 8, 9, 10, 13, 20, 40, 41, 100, 300):
        stem = words(rng, n)
        texts += [stem, stem + " tail", stem + " tail of words", stem.upper(), " ".join(stem.split()[1:]), words(rng, n)]
    for _ in range(40):
        stem = words(rng, rng.randrange(6, 200)).split()
        other = list(stem)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = "changed"
        texts += [" ".join(stem), " ".join(other)]
    return texts + [None, "", "  ", texts[0], texts[0]]


def test_near_copies_agree_with_brute_force(spark, tmp_path, monkeypatch):
    texts = near_copies()
    there = folder(spark, tmp_path, documents=[document(i, t) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["component_id"] for r in rows_of(jaccard_join.query(spark, there))}
    assert [found[i] for i in range(len(texts))] == linked(texts)


def test_second_signing_makes_rows_of_what_is_left_only(spark):
    """Documents that a bitmap lets through beside those that are left make no rows; before, they grew with documents times sets."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, words(rng, 40)) for i in range(6000)], "doc_id bigint, text string")
    sets = dict(zip(range(6000), jaccard_join.shingle_sets([r["text"] for r in docs.orderBy("doc_id").collect()])))
    classes = spark.createDataFrame([(i, *jaccard_join._keys(s)) for i, s in sets.items()], "rep bigint, node bigint, twin bigint")
    left = classes.where("rep < 400").selectExpr("node", "5L AS level")
    rows = jaccard_join._signed_again(docs, classes, left)
    signed = rows.where(f"kind = {jaccard_join.SPARE}").selectExpr("node", "sig & 31 AS level").distinct()
    assert {tuple(r.values()) for r in rows_of(signed)} == {tuple(r.values()) for r in rows_of(left)}
    assert rows.select("node").where("node <> 0").distinct().count() == 400
    sets_of_left = jaccard_join._emit_sets(jaccard_join.Bitmap(left.select("node")))
    assert jaccard_join._restricted(docs, classes, left, sets_of_left, "node bigint, twin bigint, shingles array<bigint>").count() == 400


def test_near_copies_edges(spark, edges, nothing):
    rows = rows_of(jaccard_join.query(spark, edges))
    assert len(rows) == len(edge_documents())
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6, 7)} == {5}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    docs = with_clashes(spark.read.parquet(f"{edges}/documents.parquet"))
    kept = jaccard_join.drop_near_copies(docs)
    ids = [r["doc_id"] for r in rows_of(kept)]
    assert kept.columns == docs.columns and 6 not in ids and 7 not in ids and ids.count(5) == 3
    assert ids.count(None) == 3  # two without words, and one whose group has no id
    assert jaccard_join.query(spark, nothing).count() == 0 and jaccard_join.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(links, "a bigint, b bigint")))}
    root = {}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                low = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = low
    assert found == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(21)
    fillers = ["der die das und nicht mit", "the of and that with this"]
    texts = []
    for i in range(60):
        texts.append((f"{fillers[i % 2]} " * 3 + words(rng, 80), ["de", "en"][i % 2]))
    texts += [(texts[0][0].replace(" ", "  "), "de"), (texts[1][0] + " end", "en"), ("12 34", "en"), (None, "en"), ("", None)]
    item = words(rng, 30)
    texts.append((texts[3][0][:200] + " " + item, "en"))
    rows = [(i, t, lang, "s", None) for i, (t, lang) in enumerate(texts)] + [(None, None, None, None, None), (2, texts[2][0], "de", "s", None)]
    there = folder(spark, tmp_path, documents=rows, benchmark=[(1, item)])
    pieces = rows_of(corpus_pipeline.run(spark, there))
    kept = [(i, t) for i, t, *_ in dict.fromkeys(rows) if t and any(c.isalpha() for c in t)]
    kept = [r for n, r in enumerate(kept) if " ".join(r[1].split()) not in {" ".join(x[1].split()) for x in kept[:n]}]
    roots = linked([t for _, t in kept])
    kept = [r for n, r in enumerate(kept) if roots[n] == n and not windows_hit(r[1], [(1, item)])[1]]
    expected = {i: hashlib.sha256(np.array(ids_of(t), "<u4").tobytes()).hexdigest() for i, t in kept}
    found = {}
    for i in {r["doc_id"] for r in pieces}:
        parts = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        found[i] = hashlib.sha256(b"".join(bytes(r["ids"]) for r in parts)).hexdigest()
    assert found == expected


def test_pipeline_of_nothing_and_of_clashing_columns(spark, nothing, edges):
    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = with_clashes(spark.read.parquet(f"{edges}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edges)
        assert out.columns == docs.columns
        assert all(r["node"] == "node" and r["found"] == "found" for r in rows_of(out))
        assert stage(spark, docs.limit(0), edges).count() == 0


def _roots_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("part", [10**6, 40])
def test_components_of_parts(spark, monkeypatch, part):
    monkeypatch.setattr(component_steps, "PART_LINKS", part)
    rng = random.Random(3)
    links = [(i, i + 1) for i in rng.sample(range(60), 60)] + [(1000, 1000 + i) for i in range(1, 60)]
    links += [(rng.randrange(2000, 2150), rng.randrange(2000, 2150)) for _ in range(90)]
    rng.shuffle(links)
    rows = rows_of(components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)))
    assert {r["node"]: r["root"] for r in rows} == _roots_of(links) and len(rows) == len(_roots_of(links))


def test_few_links_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(component_steps, "_state", None)
    links = [(i, i + 1) for i in range(200)]
    assert {r["root"] for r in rows_of(components(spark.createDataFrame(links, "a bigint, b bigint")))} == {0}


def test_bitmaps_are_compared_once(spark):
    facts = "node bigint, n bigint, own binary, following binary"
    classes = spark.createDataFrame([(1, 20, b"\0" * 8, b"\0" * 8), (2, 20, b"\1" + b"\0" * 7, b"\0" * 8), (3, 20, b"\xff" * 8, b"\0" * 8)], facts)
    close = jaccard_join._filtered(spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint"), classes)
    assert rows_of(close) == [{"a": 1, "b": 2, "apart": 1}]
    assert close._jdf.queryExecution().optimizedPlan().toString().count("_close(") == 1


def test_packing_leaves_no_tables_in_workers(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id bigint, text string").repartition(8)
    assert packing.pack(docs, TOKENIZER).count()

    def held(batches):
        from rulegrain.llm import common

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len([k for k in common._HELD if k.startswith("packing")])] * batch.num_rows, pa.int64())], ["id"])

    assert {r["id"] for r in rows_of(spark.range(0, 64, 1, 8).mapInArrow(held, "id bigint"))} == {0}
