"""Registered queries over the driver's tables, and their SQL."""

from . import aggregating, filtering, graphing, logging, normalizing, stores, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
