"""Registered queries, by group."""

from footreach.plans import corridors, graphs, ingest, joins, ranking, scalar, service, shapes, streams  # noqa: F401
from footreach.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
