"""Core queries by name."""

from . import queries_evidence, queries_pages, queries_retrieval, queries_scoring  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401

FLAGSHIP = "hybrid_retrieval"
