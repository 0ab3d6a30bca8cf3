"""All registered queries."""

from labelsieve.plans import (  # noqa: F401
    evaluation_queries, quality_queries, queue_queries, reuse_queries, review_queries, scoring_queries, session_queries, source_queries,
)
from labelsieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
