"""All queries of the package's own operators."""

from . import etl, evaluation, mining, production, retrieval, sources  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
