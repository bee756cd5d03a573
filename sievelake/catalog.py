"""All registered queries of the reference's operators, with their SQL oracles."""

from sievelake.plans import corpus_queries, eval_queries, filter_queries, record_queries, source_queries, stream_queries, text_queries  # noqa: F401
from sievelake.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
