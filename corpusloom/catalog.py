"""The queries and SQL twins of the analytics operators."""

from .plans import asking, queries, reporting
from .plans.oracles import ORACLES as _ORACLES

QUERIES = queries.QUERIES | asking.QUERIES | reporting.QUERIES
ORACLES = _ORACLES | asking.SQL | reporting.SQL

__all__ = ["ORACLES", "QUERIES"]
