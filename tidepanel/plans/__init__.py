"""Registered queries. Importing this package fills the catalog."""

from tidepanel.plans import bayes_queries, factor_queries, forecast_queries, panel_queries  # noqa: F401
from tidepanel.plans.catalog import QUERIES as ALL_QUERIES
from tidepanel.plans.catalog import SQL as ALL_SQL

__all__ = ["ALL_QUERIES", "ALL_SQL"]
