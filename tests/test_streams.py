"""Streams with state, and what arrives late."""

import datetime as dt
import random

from rulegrain.plans.catalog import QUERIES
from rulegrain.streaming import streams

FINDINGS = "ts timestamp, rule_id string, file_path string, line int, `column` int, root_ordinal bigint, ordinal bigint"
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_firsts_over_several_arrivals(spark, tmp_path):
    """A hot key, rows out of order, late ones, keys that come back in a later span, and a restart after each arrival."""
    rng = random.Random(6)
    batches = []
    for b in range(4):
        rows = []
        for i in range(120):
            hours = max(0, b * 10 + rng.uniform(-4, 10))
            key = ("HOT", "hot.py") if i % 2 else (f"R{rng.randrange(3)}", f"f{rng.randrange(3)}.py")
            rows.append((at(hours), *key, 1, 1, rng.randrange(3), b * 1000 + i))
        batches.append(rows)
    batches[3] += [(at(1), "R0", "back.py", 1, 1, 0, 1), (at(39), "R0", "back.py", 1, 1, 1, 2), (at(60), "R9", "end.py", 1, 1, 0, 3)]
    batches[0] += [(at(1.5), "R0", "back.py", 1, 1, 1, 9), (at(1.6), "R0", "back.py", 1, 1, 0, 10)]
    arrived, state, found = str(tmp_path / "in"), str(tmp_path / "state"), None
    for rows in batches:
        spark.createDataFrame(rows, FINDINGS).repartition(3).write.mode("append").parquet(arrived)
        found = streams.run_dedupe(spark.readStream.schema(FINDINGS).parquet(arrived), "2 hours", "6 hours", state)

    width, firsts, late, mark, seen = dt.timedelta(hours=6), {}, {}, None, []
    for rows in batches:
        for row in rows:
            # spans are counted from the epoch, of which START is a whole number
            end = START + ((row[0] - START) // width + 1) * width
            key = (*row[1:5], end)
            kind = late if mark is not None and end <= mark else firsts
            kind.setdefault(key, []).append((row[5], row[6]))
        seen += [r[0] for r in rows]
        mark = max(seen) - dt.timedelta(hours=2)
    rows = found.collect()
    got = sorted((r.rule_id, r.file_path, r.root_ordinal, r.ordinal, r.copies) for r in rows if not r.late)
    expected = sorted((k[0], k[1], *min(v), len(v)) for k, v in firsts.items() if k[-1] <= mark)
    assert got == expected
    assert sum(r.copies for r in rows if r.late) == sum(map(len, late.values())) >= 1
    back = [(r.ordinal, r.late) for r in rows if r.file_path == "back.py"]
    assert sorted(back) == [(1, True), (2, False), (10, False)]
    assert not any(r.file_path == "end.py" for r in rows)


def test_the_sessions_state_store_stays_as_it_was(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.createDataFrame([], FINDINGS).write.parquet(str(tmp_path / "in"))
    assert streams.run_dedupe(spark.readStream.schema(FINDINGS).parquet(str(tmp_path / "in"))).count() == 0
    assert spark.conf.get(name, None) == before


def test_a_table_is_a_stream_as_one_file_or_as_a_folder(spark, tmp_path):
    """A large table lies in several files; tables whose names begin or end alike are not part of it."""
    rows = [(i, f"token = 'hT6wq0Vz9LxB' {i}\n", "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.repartition(2).write.parquet(str(tmp_path / "many" / "my_documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one_file"))
    (tmp_path / "one").mkdir()
    (part,) = (tmp_path / "one_file").glob("part-*.parquet")
    (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
    for folder in ("many", "one"):
        found = QUERIES["stream_scan"](spark, str(tmp_path / folder)).collect()
        assert sorted((r.repo, r.file_path, r.rule_id) for r in found) == [("s", f"{i}.txt", "SEC006") for i in range(6)]
