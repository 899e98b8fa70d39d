"""All queries of the engine's own operators."""

from corvane import layer_queries, relational_queries, retrieval_queries
from corvane.registry import QUERIES, SQL

flagship = retrieval_queries.flagship
__all__ = ["QUERIES", "SQL", "flagship", "layer_queries", "relational_queries"]
