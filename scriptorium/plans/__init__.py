"""Registered queries of the library."""

from . import corpus_queries, ledger_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query

__all__ = ["ORACLES", "QUERIES", "Query"]
