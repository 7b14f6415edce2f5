"""Registered queries over the driver's tables."""

from . import logs, pages, scoring, sites, sources, streams, tenants  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
