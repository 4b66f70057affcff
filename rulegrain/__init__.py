"""rulegrain: security findings over source, dependency and response tables, as Spark jobs."""

__version__ = "0.1.0"
