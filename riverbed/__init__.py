"""Standing queries over streams and tables of JSON events, on Spark."""

from .operators.match import match_by_filter, match_by_join, per_client
from .plans.compile import matches, where
from .plans.query import Query, QueryError, parse
from .plans.registry import Registry

__all__ = ["Query", "QueryError", "Registry", "match_by_filter", "match_by_join", "matches", "parse", "per_client", "where"]
