"""Refreshing rollups from newly arrived files."""

from .watch import watch_allocations

__all__ = ["watch_allocations"]
