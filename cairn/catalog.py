"""Every query of the library by name, and the SQL of those that SQL can express."""

from cairn.plans import graphs, retrieval, runs, sources, texts  # noqa: F401
from cairn.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
