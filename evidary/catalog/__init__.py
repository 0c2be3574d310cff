"""Registered queries over the given tables."""

from evidary.catalog import (  # noqa: F401
    queries_docs,
    queries_place,
    queries_rank,
    queries_recur,
    queries_runs,
    queries_sources,
    queries_text,
    queries_verify,
)
from evidary.catalog.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
