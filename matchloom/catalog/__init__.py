"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from matchloom.catalog import corpus, history, matching, operations, sources, text  # noqa: F401  (registration)
from matchloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
