"""Streams of documents: files as they arrive, matches kept up to date, and rollups over event time."""

from .documents import rollup, watch_statements
from .matching import Matching, match_stream

__all__ = ["Matching", "match_stream", "rollup", "watch_statements"]
