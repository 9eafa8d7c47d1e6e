"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from freshet.plans import files, lakes, places, reaches, roads, shown, terrain, times

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (places, terrain, reaches, times, roads, lakes, files, shown):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
