"""Reports as one whole document per repository, all of them or none.

The rows of all reports are range-partitioned and written in order, so that the parts of a document, large or
small, are written by many tasks. A data source writer then puts each document's parts together as a stream of
bytes, under a name of its own attempt. Only when all tasks have ended do the documents get their names; if one
fails, none does, and what the attempts wrote is removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.ship import ship_package
from ..sources.tables import shared_folder
from .reports import ORDER

_COPIED = 1 << 20


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder; a plain path, or one with the scheme ``file``, is one that all executors mount."""
    plain = re.sub(r"^file:/+", "/", uri)
    return (pa.fs.LocalFileSystem(), plain) if plain.startswith("/") else pa.fs.FileSystem.from_uri(plain)


def _documents_in(uri: str) -> list[str]:
    system, folder = _place(uri)
    return [f.path for f in system.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))]


def document_name(repo: str | None, suffix: str) -> str:
    """File name of a repository's document; no two repositories share one."""
    return ("%" if repo is None else quote(repo, safe=" ").replace(".", "%2E") or "%00") + suffix


@dataclass
class _Written(WriterCommitMessage):
    """What a task has put together: (attempt's file, document's file)."""

    files: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    """Rows (repo, part_folder) become documents; ``uri`` is their folder."""

    def __init__(self, uri: str, suffix: str) -> None:
        self.uri, self.suffix = uri, suffix
        #: Attempts write below a folder of this write alone.
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _place(self.uri)
        files = []
        for batch in iterator:
            for repo, parts in zip(batch.column("repo").to_pylist(), batch.column("part_folder").to_pylist()):
                attempt = f"{folder}/{self.attempts}/{uuid.uuid4().hex}"
                system.create_dir(f"{folder}/{self.attempts}", recursive=True)
                self._put_together(system, parts, attempt)
                files.append((attempt, f"{folder}/{document_name(repo, self.suffix)}"))
        return _Written(files)

    def _put_together(self, system: pa.fs.FileSystem, parts: str, attempt: str) -> None:
        """The parts in order of their names, which is that of the tasks that wrote them."""
        source, folder = _place(parts)
        found = source.get_file_info(pa.fs.FileSelector(folder))
        names = sorted(f.path for f in found if f.is_file and f.base_name.startswith("part-"))
        with system.open_output_stream(attempt) as out:
            for name in names:
                with source.open_input_stream(name) as part:
                    while block := part.read(_COPIED):
                        out.write(block)

    def commit(self, messages: list[_Written | None]) -> None:
        """Names only: each document is renamed, and no content is read."""
        system, folder = _place(self.uri)
        for message in messages:
            for attempt, document in message.files if message else ():
                system.move(attempt, document)
        self._clear(system, folder)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_place(self.uri))

    def _clear(self, system: pa.fs.FileSystem, folder: str) -> None:
        """Attempts that failed or were repeated go; the folder is this write's own."""
        if system.get_file_info(f"{folder}/{self.attempts}").type == pa.fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.attempts}")


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rulegrain_documents"

    def schema(self) -> str:
        return "repo string, part_folder string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["uri"], self.options["suffix"])


def write_documents(report: DataFrame, uri: str, suffix: str = ".json") -> None:
    """One file per repository of report rows (repo, the order's columns, text) in a new or empty folder.

    A file holds its rows' texts in order, a line each. ``uri`` is a folder that every executor reaches: a path they
    all mount, or the address of a store that Arrow knows. A repository's name, with signs escaped, is its file's name;
    rows without repository are the file ``%``. A report without rows makes no file. Each document is put together by
    one task, which holds a piece of it at a time. If any task fails in the end, there are no documents.
    """
    spark = report.sparkSession
    if _documents_in(uri):
        raise FileExistsError(f"{uri} is not empty")
    ship_package(spark)
    parts = shared_folder(spark)
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), F.col("repo")), F.lit("")), 256)
    named = report.withColumn("_document", digest)
    ordered = named.orderBy("_document", *[F.col(f"`{c}`").asc_nulls_first() for c in ORDER])
    ordered.select("_document", "text").write.partitionBy("_document").mode("errorifexists").text(parts)
    folders = named.select("repo", F.concat(F.lit(f"{parts}/_document="), "_document").alias("part_folder")).distinct()
    spark.dataSource.register(DocumentSink)
    folders.write.format(DocumentSink.name()).mode("append").option("uri", uri).option("suffix", suffix).save()
