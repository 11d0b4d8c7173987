"""The query catalogue: every named query with its SQL oracle, collected from the modules of this package."""

from __future__ import annotations

from tessera.plans import agreement, detail, events, review, sql_surface, streams, tracks
from tessera.plans.registry import ORACLES, QUERIES

MODULES = (tracks, events, agreement, review, detail, sql_surface, streams)
FLAGSHIP = "preset_contest_windows"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
