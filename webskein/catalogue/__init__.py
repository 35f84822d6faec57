"""Registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from webskein.catalogue import crawling, evaluation, indexing, lifecycle, retrieval

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (retrieval, indexing, lifecycle, evaluation, crawling):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
