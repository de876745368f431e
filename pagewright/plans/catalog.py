"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from . import corpus, extraction, judged, maintenance, retrieval  # noqa: F401  register their plans
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
