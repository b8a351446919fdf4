"""All registered queries."""

from risewatch.catalog import activity, files, graphs, models, payloads, records, scoring, series, streams  # noqa: F401
from risewatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
