"""Run a query on Spark and its SQL on DuckDB, and compare the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(name):
    return {"integer": "int", "varchar": "string", "bigint": "bigint", "hugeint": "hugeint", "timestamp": "timestamp_ntz"}.get(name, name)


def difference(spark, con, fn, sql, sf_dir):
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    mine = {n: kind(t) for n, t in df.dtypes}
    other = {n: kind(str(t).lower()) for n, t in zip(rel.columns, rel.types)}
    types = {n: (mine[n], other[n]) for n in mine if mine[n] != other[n]}
    note = f" types {types}" if types else ""
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} / {len(want)}, only here {extra}, only there {missing}{note}"
    if types:
        return note
    return None
