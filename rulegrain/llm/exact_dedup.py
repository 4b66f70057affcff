"""Exact deduplication: skew-safe combining of equal texts.

Copies are folded in three steps, and each compares whole texts, not digests only, because the text
itself is a grouping key: first inside every input partition (the partial aggregate before the first
shuffle), then inside a salt of the digest, where the salt is a property of the partition and so does
not split what a partition has already folded, last over the salts. A text that a third of all rows
share reaches the last step as at most ``salts`` rows.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import stored
from .common import quoted

#: Rows of a text from which its winner is broadcast, and how many such winners there are at most.
LARGE_GROUP, LARGE_TEXTS = 1_000, 100_000
#: White space that counts as one space: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"\x20\x09-\x0D"


def normalised(text: Column) -> Column:
    """Null as empty, every run of white space as one space. Single spaces are not touched at all."""
    runs = rf"\x20[{SPACES}]+|[\x09-\x0D][{SPACES}]*"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(quoted(id_col).alias("doc_id"), normalised(quoted(text_col)).alias("text"))
    return text.withColumn("text_sha256", F.sha2(F.encode("text", "utf-8"), 256))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest id), group_size (rows).

    Two different texts with one SHA-256 would end the job with an error instead of being mixed up.
    """
    salted = _keyed(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    local = salted.groupBy("text_sha256", "salt", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = local.groupBy("text_sha256", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    once = whole.groupBy("text_sha256").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts")
    )
    clash = F.raise_error(F.concat(F.lit("two texts share the digest "), "text_sha256")).cast("bigint")
    return once.select(
        "text_sha256", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(clash).alias("group_size")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, dropped ones too.

    Defined results: a null text is an empty one. Each row has a row of its own in the result, rows that
    repeat both id and text too; all of them count in group_size, and are kept or dropped alike. The
    smallest id stays; a null id stays only where a group has no other. An empty table gives no rows;
    other columns are not read.

    Texts of very many rows are no join key: there are at most ``LARGE_TEXTS`` of them, whose winners are
    broadcast, and their rows are dealt by id.
    """
    kept = stored(winners(docs, id_col, text_col, salts))
    rows = kept.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") > max(LARGE_GROUP, rows // LARGE_TEXTS)
    names = {"text_sha256": "sha", "keep_id": "keep", "group_size": "size"}
    ours = kept.where(large).withColumnsRenamed({"keep_id": "large_keep", "group_size": "large_size"})
    members = _keyed(docs, id_col, text_col).select("doc_id", "text_sha256").join(F.broadcast(ours), "text_sha256", "left")
    key = F.when(F.col("large_size").isNull(), F.col("text_sha256")).otherwise(F.xxhash64("doc_id").cast("string"))
    found = members.withColumn("key", key).join(kept.where(~large).withColumnsRenamed(names), F.col("key") == F.col("sha"), "left")
    of_large = F.col("large_size").isNotNull()
    found = found.select(
        "doc_id", F.when(of_large, F.col("large_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(of_large, F.col("large_size")).otherwise(F.col("size")).alias("group_size"), "text_sha256",
    )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs``, with all their columns, that exact_groups keeps, each document once.

    Of rows that repeat id and text, the one whose other columns sort first stays (compared as JSON).
    """
    digest = F.sha2(F.encode(normalised(quoted(text_col)), "utf-8"), 256)
    kept = winners(docs, id_col, text_col, salts)
    members = _keyed(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    kept = kept.join(members.withColumnRenamed("text_sha256", "sha"), on=(
        (F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )).select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("rows").alias("__rows"))
    row = F.struct(*[quoted(c) for c in docs.columns])
    held = docs.select(row.alias("__row"), digest.alias("__digest"), quoted(id_col).alias("__id")).join(
        kept, (F.col("__digest") == F.col("__sha")) & F.col("__id").eqNullSafe(F.col("__keep"))
    )
    single = held.where("__rows = 1").select("__row.*")
    repeated = held.where("__rows > 1").groupBy("__digest").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return single.unionByName(repeated.select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
