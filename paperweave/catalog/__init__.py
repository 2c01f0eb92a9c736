"""All registered queries, by area."""

from paperweave.catalog import columns, labels, learning, matching, sources_sinks, statements  # noqa: F401
from paperweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
