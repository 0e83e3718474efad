"""Registered queries and their SQL."""

from umbra.plans import more as _more, streams as _streams  # register their queries  # noqa: F401
from umbra.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
