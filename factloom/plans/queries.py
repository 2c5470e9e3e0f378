"""All registered queries of this folder and their SQL."""

from __future__ import annotations

from . import derived, engine_queries
from .standins import QUERIES, SQL

#: The modules whose import registers queries beside those of ``standins``.
REGISTERED = (derived, engine_queries)

__all__ = ["QUERIES", "REGISTERED", "SQL"]
