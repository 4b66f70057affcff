"""Python facts as they are: all rows and columns of each kind.

The catalog's ``py_calls``, ``py_assigns`` and ``py_consts`` give the same rows in columns that SQL can
compare; these keep nested columns and the order of the walk. Tests compare them with plain ``ast``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import pyfacts
from . import derive

PLACE = ["repo", "path", "seq", "line", "column", "snippet", "name"]
COLUMNS = {
    "call": [*PLACE, "is_attribute", "attr", "keywords", "n_args", "dynamic_sql", "arg1_safe"],
    "assign": [*PLACE, "nonempty_str", "has_star", "is_true"],
    "const": PLACE,
}


def facts_of(corpus: DataFrame, kind: str) -> DataFrame:
    """All facts of one kind, whether a rule asks for them or not."""
    return pyfacts.py_facts(pyfacts.python_sources(corpus), watched=False).where(F.col("kind") == kind)


def _query(kind: str):
    return lambda spark, sf_dir: facts_of(derive.code_corpus(spark, sf_dir), kind).select(*COLUMNS[kind])


QUERIES = {f"py_{kind}_facts": _query(kind) for kind in COLUMNS}
