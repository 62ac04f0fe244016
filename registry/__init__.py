"""Registered queries: every operator on the given tables, with its DuckDB twin."""

from registry.base import QUERIES, oracle
from registry import (  # noqa: F401  (importing a section registers its queries)
    candidates,
    features,
    matrix,
    metrics,
    models,
    recommend,
    segments,
    sequences,
    tables,
)

__all__ = ["QUERIES", "oracle"]
