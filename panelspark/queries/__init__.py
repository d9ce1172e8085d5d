"""Queries over the driver tables; importing this package fills the registry."""

from panelspark.queries import (  # noqa: F401
    consumer_queries,
    event_queries,
    ingest_queries,
    key_queries,
    panel_queries,
    profile_queries,
    publish_queries,
    quality_queries,
    text_queries,
)
from panelspark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
