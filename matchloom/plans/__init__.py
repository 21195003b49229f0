"""Named queries over the tables of a data folder."""

from matchloom.plans import event_queries, relational_queries, ruleset_queries, stream_queries
from matchloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "event_queries", "relational_queries", "ruleset_queries", "stream_queries"]
