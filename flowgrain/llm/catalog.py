"""All corpus queries and their SQL twins."""

from __future__ import annotations

from . import queries_dedup, queries_filters, queries_layout, queries_media, queries_models  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
