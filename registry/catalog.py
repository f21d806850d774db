"""Imports every query module, so that all queries are registered."""

from registry import (  # noqa: F401
    alerts, features, ingest, labels, ml, models, quality, sessions, sources, stored, streams, traffic,
    training,
)
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
