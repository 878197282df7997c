"""Importing this module registers every query."""

from fitgrid.plans import analytics, core, events, quality, resolve, text, web  # noqa: F401
from fitgrid.plans.registry import all_queries, all_twins

__all__ = ["all_queries", "all_twins"]
