"""All registered queries."""

from mediagraph.plans import count_queries, feed_queries, graph_queries, job_queries, story_queries, stream_queries, text_queries  # noqa: F401
from mediagraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
