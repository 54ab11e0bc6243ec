"""All registered queries of the engine, by name, with the SQL that states the same result."""

from __future__ import annotations

from . import connected, crawling, documents, native, rich, running, varied

QUERIES: dict = {}
SQL: dict = {}
for _module in (native, documents, rich, varied, crawling, connected, running):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
