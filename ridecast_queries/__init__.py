"""Registered queries over the given tables, each with its SQL twin where SQL can say it.

Importing the modules registers their queries.
"""

from ridecast_queries import boosting, increments, models, preparation, profiling, scoring, tables
from ridecast_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boosting", "increments", "models", "preparation", "profiling", "scoring", "tables"]
