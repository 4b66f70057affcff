"""The package on the workers, also where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_NAME = "rulegrain_package.zip"


def ship_package(spark: SparkSession) -> None:
    """Give this package's modules to every Python worker of the session's application, once.

    Functions that run in workers refer to their modules by name. Spark's own file server hands the
    archive out, so neither an installation nor a shared folder is needed.
    """
    context = spark.sparkContext
    if any(name.endswith(_NAME) for name in context._python_includes or []):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    if not os.path.isdir(package):  # this copy is itself inside an archive that is on the path
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="rulegrain-"), _NAME)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    context.addPyFile(archive)
