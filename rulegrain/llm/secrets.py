"""Secret scans with multipart credential linking.

Each kind of part has one pattern. Strong parts are reported wherever they stand. Weak ones, such as a
short identifier, a bare 40 character key or an endpoint, mean little alone: they are reported only
where a complementary part lies in the same scope, that is at most ``scope`` characters away. Scopes
are joined as intervals: parts are dealt out by document and block of characters, copied to each block
that their scope reaches into, and a sweep in order of their starts finds the nearest end before and
the nearest start after each part. No pairs are made, and a document full of parts is spread over its
blocks.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import stored
from .common import quoted

IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
#: Characters between two parts of one credential at most, and characters of a block of the join.
SCOPE = 200
BLOCK = 4096


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])


@dataclass(frozen=True)
class Part:
    """A kind of part: its pattern, the test a match must pass (SQL over ``body``), and its role."""

    name: str
    pattern: str
    test: str
    role: int
    weak: bool


ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PARTS = (
    Part("assign", ASSIGN, "", SECRET, False),
    Part("access", "AKIA[A-Z0-9]+", "length(body) >= 20", IDENTIFIER, False),
    Part("hex", "[0-9a-f]{24,}", "true", SECRET, False),
    Part("ident", "A(?:KIA|SIA|IDA|ROA)[A-Z0-9]{12,}", "NOT (body LIKE 'AKIA%' AND length(body) >= 20)", IDENTIFIER, True),
    Part("key", "[A-Za-z0-9/+]{40,}", "length(body) = 40 AND body RLIKE '[A-Z]' AND body RLIKE '[a-z]' AND body RLIKE '[0-9]'", SECRET, True),
    Part("shorthex", "[0-9a-f]{16,}", "length(body) < 24 AND body RLIKE '[a-f]' AND body RLIKE '[0-9]'", SECRET, True),
    Part("endpoint", "https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", "true", ENDPOINT, True),
)
_FOUND = "array<struct<kind:int,gap:int,size:int,ok:boolean>>"


def _passes(part: Part, body: Column) -> Column:
    if part.name == "assign":
        return F.length(F.regexp_extract(body, ASSIGN, 2)) >= 6
    tests = {
        "access": lambda b: F.length(b) >= 20,
        "ident": lambda b: ~(b.startswith("AKIA") & (F.length(b) >= 20)),
        "key": lambda b: (F.length(b) == 40) & b.rlike("[A-Z]") & b.rlike("[a-z]") & b.rlike("[0-9]"),
        "shorthex": lambda b: (F.length(b) < 24) & b.rlike("[a-f]") & b.rlike("[0-9]"),
    }
    return tests.get(part.name, lambda b: F.lit(True))(body)


def _matches(text: Column, number: int, part: Part) -> Column:
    """All matches from left to right: characters between the last one and this, length, whether it counts."""
    gaps = F.split(text, part.pattern, -1)
    bodies = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    rows = F.zip_with(
        gaps,
        bodies,
        lambda gap, body: F.struct(
            F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(body).alias("size"), _passes(part, body).alias("ok")
        ),
    )
    found = F.filter(rows, lambda r: r["size"].isNotNull()).cast(_FOUND)
    return F.when(text.rlike(part.pattern), found).otherwise(F.array().cast(_FOUND))


def scan_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without their text, with a row key and all matches, written once.

    The key is given while the table is written, and so holds for all that reads the table.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    found = F.flatten(F.array(*[_matches(F.col("__text"), i, p) for i, p in enumerate(PARTS)]))
    kept = [quoted(c) for c in docs.columns if c != text_col]
    held = docs.select(F.struct(*kept).alias("document"), text.alias("__text"))
    return stored(held.select(F.monotonically_increasing_id().alias("key"), "document", found.alias("found")))


def part_spans(scanned: DataFrame) -> DataFrame:
    """key, kind, start, end of every match that counts, in characters, end exclusive."""
    rows = scanned.select("key", F.posexplode("found").alias("place", "m")).select("key", "place", "m.*")
    order = Window.partitionBy("key", "kind").orderBy("place")
    end = F.sum(F.col("gap").cast("bigint") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).where("ok").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def link(spans: DataFrame, scope: int = SCOPE, block: int = BLOCK) -> DataFrame:
    """The spans to report: strong ones, and weak ones whose complement is in scope.

    An identifier and a secret complete each other; an endpoint needs both.
    """
    role = F.element_at(F.array(*[F.lit(p.role) for p in PARTS]), F.col("kind") + 1)
    weak = F.element_at(F.array(*[F.lit(p.weak) for p in PARTS]), F.col("kind") + 1)
    first, last = F.floor((F.col("start") - scope) / block), F.floor((F.col("end") + scope) / block)
    dealt = spans.select("*", role.alias("role"), weak.alias("weak"), F.explode(F.sequence(first, last)).alias("block"))
    order = Window.partitionBy("key", "block").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(wanted: int) -> Column:
        ended = F.max(F.when(F.col("role") == wanted, F.col("end"))).over(before)
        starts = F.min(F.when(F.col("role") == wanted, F.col("start"))).over(after)
        return F.coalesce(ended + scope >= F.col("start"), F.lit(False)) | F.coalesce(
            starts <= F.col("end") + scope, F.lit(False)
        )

    seen = dealt.withColumns({"by_identifier": near(IDENTIFIER), "by_secret": near(SECRET)})
    linked = (
        F.when(F.col("role") == IDENTIFIER, F.col("by_secret"))
        .when(F.col("role") == SECRET, F.col("by_identifier"))
        .otherwise(F.col("by_identifier") & F.col("by_secret"))
    )
    return seen.where(~F.col("weak") | linked).select("key", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """document (a struct of the other columns) and spans (array of start, kind, end, in order) of every row.

    Defined results: a null or empty text has no spans. Rows that repeat, and rows with null ids, are
    each searched on their own. Whole texts are read.
    """
    scanned = scan_parts(docs, text_col)
    found = link(part_spans(scanned), scope)
    held = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return scanned.select("key", "document").join(held, "key", "left").select("document", spans.alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(p.name) for p in PARTS])
    place = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, place), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "document.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(_listed(base), "utf-8"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: s.replace("'", "''")
    kinds = "\nUNION ALL\n".join(
        f"SELECT doc_id, {i} AS kind, {p.role} AS role, {str(p.weak).lower()} AS weak, "
        f"regexp_extract_all(t, '{quote(p.pattern)}') AS m, string_split_regex(t, '{quote(p.pattern)}') AS g FROM d"
        for i, p in enumerate(PARTS)
    )
    tests = " ".join(
        f"WHEN {i} THEN " + (f"length(regexp_extract(body, '{quote(ASSIGN)}', 2)) >= 6" if not p.test else
                             p.test.replace("body RLIKE '", "regexp_matches(body, '").replace("]'", "]')"))
        for i, p in enumerate(PARTS)
    )
    names = "[" + ", ".join(f"'{p.name}'" for p in PARTS) + "]"
    near = lambda role: (
        f"EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.role = {role} AND (o.kind, o.s, o.e) <> (p.kind, p.s, p.e)"
        f" AND o.e + {SCOPE} >= p.s AND o.s <= p.e + {SCOPE})"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (
{kinds}
), u AS (SELECT * EXCLUDE (m, g), unnest(m) AS body, unnest(range(1, len(m) + 1)) AS i,
  unnest(list_transform(range(1, len(m) + 1), lambda x: list_sum(list_transform(g[1:x], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:x - 1], lambda y: length(y))), 0))) AS s FROM k
), p AS MATERIALIZED (SELECT doc_id, kind, role, weak, s::bigint AS s, (s + length(body))::bigint AS e FROM u WHERE CASE kind {tests} END
), r AS (SELECT doc_id, kind, s, e FROM p WHERE NOT weak OR
  CASE role WHEN 0 THEN {near(1)} WHEN 1 THEN {near(0)} ELSE {near(0)} AND {near(1)} END
), a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS b,
  string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS x FROM r GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


ORACLE = _oracle()
