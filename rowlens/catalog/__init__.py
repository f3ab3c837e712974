"""All named queries."""

from __future__ import annotations

from rowlens.catalog import charts, cleaning, findings, load, profile, quality, review, statistics
from rowlens.catalog.registry import Query

_PARTS = (load, quality, cleaning, profile, statistics, charts, review, findings)
QUERIES: dict[str, Query] = {q.name: q for part in _PARTS for q in part.QUERIES}
