"""Queries over the given tables, each with the SQL that gives the same rows."""

from convolytics.catalog import (  # noqa: F401
    documents,
    enrichment,
    prompts,
    records,
    sessions,
    streams,
    talks,
    vocabulary,
)
from convolytics.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
