"""Operators run on the given tables, each beside the SQL it must agree with."""

from panelspark.queries import (cleaning, detection, effects, history,  # noqa: F401
                                joins, loads, matching, panels, quality, results,
                                spatial, stores)
from panelspark.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
