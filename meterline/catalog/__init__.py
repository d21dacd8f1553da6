"""Registered queries and their SQL."""

from meterline.catalog import cube_queries, rollup_queries, signal_queries, source_queries, stream_queries  # noqa: F401
from meterline.catalog.inputs import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
