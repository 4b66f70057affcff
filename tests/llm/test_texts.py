"""Language, secrets, personal data, quality and chat formatting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.llm import chat_format, language_id, pseudonyms, quality, secrets

from .fixtures import CLASHING, DOCUMENTS, document, edge_documents, folder, rows_of, with_clashes, words

SF = "/root/testdata/sf0.001"


def same_as_sql(found, sql, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet{'' if sf_dir == SF else '/*.parquet'}'")
    expected = con.sql(sql)
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    ours = sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect())))
    theirs = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert ours == theirs


def test_languages_of_held_out_documents(spark):
    found = language_id.query(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = rows_of(found.join(truth, "doc_id").where("held_out"))
    assert len(rows) > 300 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, tmp_path):
    german = [document(100 + i, "der die und das ist nicht ein ich", "de") for i in range(6)]
    english = [document(200 + i, "the of and this that with have", "en") for i in range(6)]
    rows = [(i, text, None, *rest) for i, text, _, *rest in edge_documents()] + german + english
    found = rows_of(language_id.query(spark, folder(spark, tmp_path, documents=rows)))
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2, 4)] == ["und"] * 4 and by_id[0]["score"] == 0
    assert by_id[100]["lang_pred"] == "de" and by_id[200]["lang_pred"] == "en"


def test_language_without_training_rows_and_with_clashing_columns(spark):
    docs = with_clashes(spark.createDataFrame([document(1, "some text"), document(2, None)], DOCUMENTS))
    model = language_id.fit(docs.limit(0))
    found = rows_of(language_id.predict(docs, model))
    assert {r["lang_pred"] for r in found} == {"und"} and found[0]["node"] == "node"
    assert rows_of(language_id.predict(docs.limit(0), model)) == []
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), max_languages=1)


def plain_buckets(text):
    """Buckets of the n-grams of one text, character by character."""
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            gram = low[i : i + n]
            if gram == " " or "  " in gram:
                continue
            mixed = n * 0x27D4EB2F & 0xFFFFFFFF
            for c, factor in zip(gram, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                mixed = (mixed ^ ord(c) * factor & 0xFFFFFFFF) * 0x2C1B3C6D & 0xFFFFFFFF
                mixed ^= mixed >> 13
            yield mixed >> 17


def plain_bayes(rows):
    """doc_id, held_out, lang_pred and score of rows (doc_id, text, lang)."""
    held_out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    counts, docs = {}, Counter()
    for i, text, lang in rows:
        if not held_out(i) and text is not None and lang is not None:
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_buckets(text))
    for i, text, _ in rows:
        grams, sums = list(plain_buckets(text or "")), {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + 0.5 * 2**15
            sums[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams)
        best = max(sums, key=sums.get)
        score = 1 / sum(math.exp(x - sums[best]) for x in sums.values())
        yield (i, held_out(i), best, score) if any(map(str.isalpha, text or "")) else (i, held_out(i), "und", 0.0)


def test_languages_agree_with_plain_bayes(spark, tmp_path):
    rng = random.Random(4)
    letters = {"de": "aeinrstßü", "en": "aehiorst", "el": "αειορσς"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 7))), lang) for i, lang in enumerate(["de", "en", "el"] * 20)]
    rows += [(100 + i, t, rng.choice(["de", None])) for i, t in enumerate([None, "", " \t", "a", "A-Z 12", "x", "\u4e2d\U0001f600", "İstanbul"])]
    rows += [(None, "sort it", "en"), (3, "again", "de")]
    found = rows_of(language_id.query(spark, folder(spark, tmp_path, documents=[(*r, "s", 1) for r in rows])))
    order = lambda r: (str(r[0]), r[2], r[3])
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in found), key=order)
    want = sorted(plain_bayes(rows), key=order)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-4)


def many_languages(n):
    """Documents in languages with words of their own."""
    own = [" ".join(chr(0x4E00 + 7 * i + j) * 2 for j in range(7)) for i in range(n)]
    return [(f"{own[i]} {own[i][::-1]}", f"l{i:04d}") for i in range(n) for _ in range(2)]


@pytest.mark.parametrize("n", [65, 130])
def test_more_languages_than_one_block_holds(spark, n):
    docs = spark.createDataFrame(many_languages(n), "text string, lang string").repartition(3)
    model = language_id.fit(docs)
    assert len(model.languages) == n and len(model.blocks) == -(-n // language_id.BLOCK)
    found = rows_of(language_id.predict(docs, model))
    assert len(found) == 2 * n and all(r["lang_pred"] == r["lang"] and r["lang_score"] > 0.9 for r in found)


def test_blocks_of_languages_give_the_same_scores(spark, monkeypatch):
    rows = [(f"{text} the and of", lang) for text, lang in many_languages(30)] + [("the and", "l0003"), ("of of", "l0020")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    texts = [text for text, _ in rows] + ["the", "", None, "of and"]
    whole = language_id.predict_texts(language_id.fit(docs), texts)
    monkeypatch.setattr(language_id, "BLOCK", 4)
    monkeypatch.setattr(language_id, "KEPT_BLOCKS", 2)
    found = language_id.predict_texts(language_id.fit(docs), texts)
    assert found[0] == whole[0] and np.allclose(found[1], whole[1], rtol=1e-9)


def test_secrets_agree_with_sql(spark, tmp_path):
    rng = random.Random(3)
    pieces = [
        "password=", "Secret : ", "api_key='", "AKIA", "ABCDEFGH12345678", "AKIAABCDEFGH1234", "deadbeef" * 3, "0123456789abcdef",
        "token=token=abcdefgh", "secret=ab", "é", "\n", " word ", "https://host.example/path?x=1", "aA0/" * 10, "x" * 150,
    ]
    rows = [document(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [document(1000, None), document(1001, ""), document(1002, ("AKIA" + "Z" * 12 + " " + "password=hunter22 " + "y" * 900) * 200)]
    there = folder(spark, tmp_path, documents=rows)
    same_as_sql(secrets.query(spark, there), secrets.ORACLE, there)


def test_weak_parts_need_their_complement(spark):
    lone, pair, far = "AKIA" + "Q" * 12, "AKIA" + "Q" * 12 + " password=hunter22", "AKIA" + "Q" * 12 + "." * 300 + "password=hunter22"
    docs = with_clashes(spark.createDataFrame([document(1, lone), document(2, pair), document(3, far), document(3, far)], DOCUMENTS))
    found = rows_of(secrets.scan_secrets(docs))
    kinds = sorted((r["document"]["doc_id"], [s["kind"] for s in r["spans"]]) for r in found)
    assert kinds == [(1, []), (2, [3, 0]), (3, [0]), (3, [0])]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_base_spans_of_edge_documents(spark, tmp_path):
    rows = edge_documents()
    found = rows_of(secrets.query(spark, folder(spark, tmp_path, documents=rows)))
    assert len(found) == len(rows)
    assert {r["base_sha256"] for r in found if r["doc_id"] in (0, 1, 2)} == {hashlib.sha256(b"").hexdigest()}


def test_permutation_is_one_to_one():
    p = pseudonyms.Permutation(b"k")
    assert sorted(p.of("t", 1000, i) for i in range(1000)) == list(range(1000))
    even = range(0, 97, 2)
    assert sorted(p.of("d", 97, i, lambda n: n % 2 == 0) for i in even) == list(even)


def test_addresses_have_images_of_their_own():
    """Names of one letter at all domains of two: no two share an image, and none is its own."""
    p = pseudonyms.Permutation(b"k")
    for size in (2, 3, 26, 97, 1000):
        images = [p.moved("m", size, i) for i in range(size)]
        assert sorted(images) == list(range(size)) and all(i != x for i, x in enumerate(images))
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{a}@{b}{c}.com" for a in letters for b in letters for c in letters] + [f"._%@{a}{b}.org" for a in letters for b in letters]
    images = [pseudonyms._email(n, p) for n in names]
    assert len(set(images)) == len(names) and not any(a == b for a, b in zip(names, images))


def test_pseudonyms_keep_formats_and_links():
    p = pseudonyms.Permutation(b"k")
    text = "card 4111 1111 1111 1111 or 4111111111111111, call +1 (212) 555-0100 or 212-555-0100, DE89 3704 0044 0532 0130 00, "
    text += "born 1990-03-12, ssn 123-45-6789, host 192.168.1.7, mail first.last42@example.com"
    hidden, spans = pseudonyms.hide(text, p)
    assert [k for _, _, k in spans] == ["card", "card", "phone", "phone", "iban", "date", "ssn", "ip", "email"]
    values = [text[a:b] for a, b, _ in spans]
    assert not any(v in hidden for v in values)
    again, found = pseudonyms.hide(hidden, p)
    assert [k for _, _, k in found] == [k for _, _, k in spans]  # all pass validation once more
    new = [hidden[a:b] for a, b, _ in found]
    assert re.sub(r"\D", "", new[0]) == new[1] and re.sub(r"\D", "", new[2])[1:] == re.sub(r"\D", "", new[3])
    assert new[7].startswith("192.168.") and new[8].endswith("@example.com") and new[4].startswith("DE")


def test_values_beside_other_numbers_are_hidden():
    p = pseudonyms.Permutation(b"k")
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    plain = card.replace(" ", "")
    texts = [(f"{card} {cvv}", card) for cvv in range(100, 1000, 7)] + [(f"{card} {cvv}", card) for cvv in range(1000, 10_000, 997)]
    texts += [(f"{plain} 12/27", plain), (f"ref 12 {plain}", plain), (f"2024-01-15 {plain}", plain), (f"10.0.0.1 {card}", card)]
    texts += [(f"123456 {card}", card), (f"212 555 {card}", card), ("3782 822463 10005 1234", "3782 822463 10005"), (f"{card} 99 {card}", card)]
    texts += [("7 41111111 11111111 123", "41111111 11111111"), (f"DE89 3704 0044 0532 0130 00 {card}", card)]
    texts += [(f"{iban} EUR", iban), (f"{iban} 2024", iban), (f"BE12 {iban} EUR", iban), ("DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00")]
    for text, value in texts:
        hidden, spans = pseudonyms.hide(text, p)
        alone, _ = pseudonyms.hide(value, p)
        assert value not in hidden and alone in hidden, text  # the same pseudonym as without neighbours
        assert value in [text[a:b] for a, b, _ in spans], text


def test_dates_and_phones_in_rows_are_no_cards():
    p = pseudonyms.Permutation(b"k")
    for i in range(10, 29):
        text = f"2024-01-{i} 2024-02-{i} 212-555-01{i} 212-555-02{i} 123-45-67{i}"
        assert [k for _, _, k in pseudonyms.hide(text, p)[1]] == ["date", "date", "phone", "phone", "ssn"]


def test_long_rows_of_digits_stay_quick():
    p = pseudonyms.Permutation(b"k")
    assert pseudonyms.hide("1 " * 200_000, p) == ("1 " * 200_000, [])
    assert pseudonyms.hide("1" * 200_000, p) == ("1" * 200_000, [])


def test_numbers_that_fail_validation_stay():
    p = pseudonyms.Permutation(b"k")
    for text in ("4111111111111112", "1990-13-45", "000-12-3456", "300.1.1.1", "DE00 3704 0044 0532 0130 00", "12345", "1.2.3.4.5"):
        assert pseudonyms.hide(text, p) == (text, [])


def test_pseudonyms_of_edge_documents(spark, tmp_path):
    rows = edge_documents()
    found = rows_of(pseudonyms.query(spark, folder(spark, tmp_path, documents=rows)))
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in found])) == sorted(map(repr, [r[:2] for r in rows]))
    docs = with_clashes(spark.createDataFrame([document(1, "1.2.3.4")], DOCUMENTS))
    kept = pseudonyms.pseudonymise(docs, b"k")
    assert kept.columns == [*docs.columns, "pii_spans"] and rows_of(kept)[0]["spans"] == "spans"
    assert pseudonyms.pseudonymise(docs.limit(0), b"k").count() == 0


def test_pseudonyms_of_planted_values_agree_with_a_plain_version(spark, tmp_path):
    rewrite = {k: f for k, _, _, f in pseudonyms.KINDS}
    values = {
        "email": ["jo.doe7@mail.example", "a@b.example"], "iban": ["ES91 2100 0418 4502 0005 1332", "DE89370400440532013000"],
        "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004"], "date": ["1990-03-12", "31.12.2001"],
        "ssn": ["123-45-6789"], "ip": ["192.168.1.7", "8.8.4.4"], "phone": ["+1 (212) 555-0100", "212-555-0100", "+44 20 7946 0958"],
    }
    rng, rows, want, images = random.Random(6), [], [], {}
    p = pseudonyms.Permutation(pseudonyms.DEMO_KEY)
    for i in range(40):
        text, hidden, spans = "é\U0001f600 ", "é\U0001f600 ", []
        for _ in range(rng.randrange(6)):
            kind = rng.choice(list(values))
            value = rng.choice(values[kind])
            image = images.setdefault(value, rewrite[kind](value, p))
            spans.append(f"{kind}:{len(text)}:{len(text) + len(value)}")
            text, hidden = f"{text}{value} EUR, then ", f"{hidden}{image} EUR, then "
        rows.append(document(i, text))
        want.append((i, hidden, len(spans), ",".join(spans)))
    rows.append(document(40, None))
    want.append((40, None, 0, ""))
    found = rows_of(pseudonyms.query(spark, folder(spark, tmp_path, documents=rows)))
    assert sorted((r["doc_id"], r["text"], r["n_pii"], r["spans"]) for r in found) == want
    plain = lambda value: re.sub(r"\D", "", images[value])
    assert all(images[v] != v for v in images) and plain("4111 1111 1111 1111") == plain("4111111111111111")


def test_quality_of_held_out_documents(spark):
    found = quality.query(spark, "/root/testdata/sf0.1").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = rows_of(found.join(truth, "doc_id"))
    assert len(rows) > 500 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_quality_without_labels_and_of_edge_documents(spark, tmp_path):
    rows = edge_documents()
    found = rows_of(quality.query(spark, folder(spark, tmp_path, documents=rows, labels=[(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 1, 0)])))
    assert len(found) == len(rows) and len({r["score"] for r in found}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    docs = with_clashes(spark.createDataFrame([document(1, "t")], DOCUMENTS)).withColumn("quality_score", F.lit("old"))
    scored = quality.score(docs, quality.fit_rows(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert rows_of(scored)[0]["quality_score"] == 0.5 and quality.score(docs.limit(0), quality.fit_rows(np.zeros((0, 22)), np.zeros(0))).count() == 0


def test_quality_counts_a_repeated_id_once(spark, monkeypatch):
    docs = [(i, f"text of number {i}") for i in range(60)] + [(7, f"other {i} " * (i + 1)) for i in range(100)]
    labels = [(i, i % 2) for i in range(60)] + [(7, 0)] * 70 + [(7, 1)] * 30 + [(8, 1)]
    fitted = []
    monkeypatch.setattr(quality, "fit_rows", lambda x, good: fitted.append((x, good.tolist())))
    for rows in (docs, docs[::-1]):
        table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        quality.fit(table, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    good = [float(i % 2) for i in range(60)]
    good[7], good[8] = 0.0, 1.0  # most labels of 7 are 0; 8 has as many of each
    assert [g for _, g in fitted] == [good] * 2
    assert fitted[0][0].shape == (60, len(quality.FEATURES)) and (fitted[0][0] == fitted[1][0]).all()


def test_trees_walk_like_plain_code():
    rng = np.random.default_rng(1)
    rows = rng.random((500, len(quality.FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = quality.fit_rows(rows, labels)

    def plain(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(rows[:50]), [plain(r) for r in rows[:50]])
    assert ((trees.score(rows) > 0.5) == labels).mean() > 0.95


def conversation_rows():
    rng = random.Random(9)
    marks = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "\n", "é", "text ", "assistant\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(marks) for _ in range(rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    return rows + [(70, 0, "user", None), (70, 1, "assistant", None), (71, 0, "assistant", words(rng, 50_000))]


def test_conversations_agree_with_sql(spark, tmp_path):
    there = folder(spark, tmp_path, conversations=conversation_rows())
    same_as_sql(chat_format.query(spark, there), chat_format.ORACLE, there)


def test_conversations_round_trip_over_small_batches(spark, monkeypatch):
    rows = conversation_rows() + [(80, 0, "odd\nrole\\", "a"), (80, 0, "odd\nrole\\", "a"), (None, None, None, "lost"), (None, 3, "assistant", "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit("clash"))
        found = {r["conv_id"]: r for r in rows_of(chat_format.format_conversations(table))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for name in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == name), key=order)]
        one = found[name]
        assert chat_format.read_back(one["formatted"]) == turns and one["n_turns"] == len(turns)
        places = one["loss_spans"]
        texts = [chat_format._unescape(one["formatted"][a:b]) for a, b in zip(places[::2], places[1::2])]
        assert texts == [t for r, t in turns if r == "assistant"]


def test_no_conversations(spark, tmp_path):
    assert [r["conv_id"] for r in rows_of(chat_format.query(spark, folder(spark, tmp_path)))] == [-1]
    assert len(CLASHING) > 10
