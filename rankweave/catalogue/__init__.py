"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from . import bootstraps, checks, geometry, identity, learning, ranking, rasters, running, text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (ranking, bootstraps, identity, checks, geometry, text, learning, running, rasters):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
