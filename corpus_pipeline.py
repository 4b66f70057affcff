"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows it is given, and returns a DataFrame: all but
the last return the columns of ``docs``. Extra columns go along untouched, whatever their names. A row
with a null or empty text, or with a null id, has a defined fate in each stage's docstring; a table
without rows gives one without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from rulegrain.sources.tables import stored

#: Least posterior probability of a document's language.
MIN_LANGUAGE_SCORE = 0.5
TOKENIZER = "word_bpe_49k.json"


def _beside_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text, so that no column of an operator clashes with it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("text"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach.

    Those without any letter, a null or empty text among them, go, and those whose best language is less
    likely than MIN_LANGUAGE_SCORE. Without any labelled document nothing can be learned and all rows
    with a letter stay.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = language_id.predict(_beside_rows(docs), model)
    kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)
    return found.where(kept).select("document.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space, the one with the smallest id.

    Null and empty texts are equal. Rows that repeat stay once.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one with the smallest id.

    Texts without words are linked with nothing and stay; documents without id go if their group has one with an id.
    """
    return jaccard_join.drop_near_copies(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item. Null and empty texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_beside_rows(docs), items)
    return found.where(F.size("found.hits") == 0).select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, with their ids; a null text is its closing id."""
    found = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return found.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Naive Bayes, connected components over hashed sets and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
