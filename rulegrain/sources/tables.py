"""Tables kept between steps, in the folder the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions without the setting, by application; they go when Python ends.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names for checkpoints.

    Where it names none, a session inside one process (tests, a trial on a laptop) gets a folder of its
    own; any other session has to name one that all its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can see")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.TemporaryDirectory(prefix="rulegrain-")
        base = _LOCAL[context.applicationId].name
    return os.path.join(base, f"rulegrain-{uuid.uuid4().hex}")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """The rows written once and read back; where ``by`` names the last columns, a reader of some of their values skips the rest.

    For results that several later steps read: without it each step would run the scan again, and a
    lost executor would take more than its own tasks with it.
    """
    folder = shared_folder(df.sparkSession)
    df.write.mode("errorifexists").partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def constant_table(spark: SparkSession, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A table of constants that is part of the plan itself: reading it takes no job."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    arrays = [pa.array(values, kinds[kind]) for values, kind in zip(zip(*rows), columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
