"""Registered queries and their SQL counterparts."""

from . import extraction, files, joins, layouts, rollups, scalars, series, views, words  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
