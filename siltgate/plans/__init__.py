"""Registered queries, their SQL and the views they run on."""

from . import catalog, more

__all__ = ["catalog", "more"]
