"""Registered queries: importing this package fills the registry."""

from rivermeld.catalog import joins, measures, rows, scores, streams  # noqa: F401
from rivermeld.catalog.registry import ORACLES, QUERIES, Inputs

__all__ = ["ORACLES", "QUERIES", "Inputs"]
