import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    """Builds a corpus from {path: text or bytes}."""

    def build(files, repo="r"):
        rows = []
        for path, body in files.items():
            data = body.encode("utf-8") if isinstance(body, str) else body
            rows.append((repo, path, len(data or b""), bytearray(data) if data is not None else None))
        return spark.createDataFrame(rows, "repo string, path string, length bigint, content binary")

    return build
