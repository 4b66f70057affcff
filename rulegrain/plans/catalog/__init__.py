"""All queries, each with the SQL that checks it where there is one."""

from . import algebra, fixes, outputs, rooted, rules, scalars, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
