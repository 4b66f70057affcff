"""The same rules over Structured Streaming inputs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.dependencies import scan_dependencies
from ..operators.findings import DEDUPE_KEYS, exit_code
from ..operators.lines import code_lines, scan_lines
from ..operators.project import env_files, mark_env_files, project_findings
from ..operators.responses import scan_responses
from ..operators.secrets import scan_secret_lines
from ..sources.ship import ship_package
from ..sources.tables import shared_folder, stored
from .firsts import FirstOfSpan, fold_spans


def stream_scan(texts: DataFrame) -> DataFrame:
    """Findings of the line rules on arriving files (repo, path, text): no state, no shuffle."""
    lines = code_lines(texts)
    return scan_lines(lines).unionByName(scan_secret_lines(lines))


def stream_responses(responses: DataFrame) -> DataFrame:
    """Findings of arriving responses (url, status, headers, cookies): no state, no shuffle."""
    return scan_responses(responses)


def batch_dependencies(files: DataFrame, advisories: Callable[[], DataFrame]) -> DataFrame:
    """Findings of a batch of manifests; ``advisories`` reads its table as it is now."""
    return scan_dependencies(files, advisories())


def batch_project(files: DataFrame, tracked: Callable[[], DataFrame], patterns: Callable[[], DataFrame]) -> DataFrame:
    """Findings of a batch of files against the index (repo, path) and the ignore lines (repo, pattern) as they are now."""
    return project_findings(mark_env_files(stored(env_files(files)), tracked(), patterns()))


def stream_dedupe(findings: DataFrame, time: str = "ts", delay: str = "1 hour", span: str = "6 hours") -> DataFrame:
    """The first finding per key and span of event time, by root and ordinal rather than by arrival.

    Needs ``root_ordinal`` and ``ordinal``. A span's keys are held as state until the watermark passes its
    end; then each gives one row, and its state goes. So a finding that comes back in a later span is
    reported again. Rows of a span that is over are given at once, marked as ``late``. ``copies`` is the
    number of rows that a row stands for.

    Each task first folds what it has of a key and span, so a key that holds much of the stream sends one
    row per task and batch to its state.
    """
    columns = [(n, t) for n, t in findings.dtypes]
    width = int(findings.sparkSession.range(1).select(F.expr(f"timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + interval {span})")).first()[0])
    millis = F.unix_millis(F.col(time).cast("timestamp"))
    timed = findings.withWatermark(time, delay).withColumn("span", millis - F.pmod(millis, F.lit(width)))
    schema = ", ".join(f"`{n}` {t}" for n, t in [*columns, ("span", "bigint"), ("copies", "bigint")])
    # rows older than the watermark are late only once their span is over, so the columns carry no watermark from here on
    folded = timed.mapInArrow(fold_spans, schema)
    out = ", ".join(f"`{n}` {t}" for n, t in [*columns, ("copies", "bigint"), ("late", "boolean")])
    return folded.groupBy(*DEDUPE_KEYS, "span").transformWithState(FirstOfSpan([n for n, _ in columns], out, width), out, "Append", "EventTime")


def stream_severity(findings: DataFrame, time: str = "ts", delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Findings per tumbling window and level."""
    windowed = findings.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "severity")
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "severity", "n")


def append_to(stream: DataFrame, folder: str):
    """Run an append stream over what has arrived; files are committed exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", os.path.join(folder, "rows"))
        .option("checkpointLocation", os.path.join(folder, "state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def each_batch(stream: DataFrame, folder: str, work, mode: str):
    """Run a stream batch by batch; each batch owns a folder it overwrites, so a replay adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(os.path.join(folder, "rows", f"batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", os.path.join(folder, "state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def run_scan(texts: DataFrame) -> DataFrame:
    spark, folder = texts.sparkSession, shared_folder(texts.sparkSession)
    append_to(stream_scan(texts), folder).awaitTermination()
    return spark.read.parquet(os.path.join(folder, "rows"))


def run_responses(responses: DataFrame, folder: str | None = None) -> DataFrame:
    spark = responses.sparkSession
    folder = folder or shared_folder(spark)
    append_to(stream_responses(responses), folder).awaitTermination()
    return spark.read.parquet(os.path.join(folder, "rows"))


def run_batches(files: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Findings of files (repo, path, length, content) that arrive, by a join with tables that change meanwhile.

    A stream's plan is made once and would keep the files a table had then. ``work`` is called for each
    batch, so the tables it reads are listed again; a batch that is run again replaces its own rows.
    """
    spark = files.sparkSession
    folder = folder or shared_folder(spark)
    each_batch(files, folder, work, "append").awaitTermination()
    return spark.read.parquet(os.path.join(folder, "rows")).drop("batch")


def run_dedupe(findings: DataFrame, delay: str = "1 hour", span: str = "6 hours", folder: str | None = None) -> DataFrame:
    """Rows of stream_dedupe over what has arrived; called again with the same folder, over what has arrived since."""
    spark = findings.sparkSession
    folder = folder or shared_folder(spark)
    ship_package(spark)
    # state with timers is kept by this provider only; a query takes the session's settings when it starts
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = append_to(stream_dedupe(findings, delay=delay, span=span), folder)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    query.awaitTermination()
    return spark.read.parquet(os.path.join(folder, "rows"))


def run_severity(findings: DataFrame) -> DataFrame:
    """Counts per window: every batch writes the windows it changed, the latest batch counts."""
    spark, folder = findings.sparkSession, shared_folder(findings.sparkSession)
    each_batch(stream_severity(findings), folder, lambda batch: batch, "update").awaitTermination()
    rows = spark.read.parquet(os.path.join(folder, "rows"))
    return rows.groupBy("window_start", "severity").agg(F.max_by("n", "batch").alias("n"))


def batch_gate(batch: DataFrame, fail_on: str) -> DataFrame:
    worst = batch.agg(F.count("*").alias("findings"), F.max("severity_rank").alias("worst"))
    return worst.select("findings", "worst", exit_code(F.col("worst"), F.lit(fail_on)).alias("exit_code"))


def stream_gate(findings: DataFrame, fail_on: str, folder: str | None = None) -> DataFrame:
    """One gate row per micro-batch; called again with the same folder, the batches that have arrived since join them."""
    spark = findings.sparkSession
    folder = folder or shared_folder(spark)
    each_batch(findings, folder, lambda batch: batch_gate(batch, fail_on), "append").awaitTermination()
    return spark.read.parquet(os.path.join(folder, "rows")).where("findings > 0")
