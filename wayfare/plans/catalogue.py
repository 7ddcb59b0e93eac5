"""Every registered query over the given tables, with its SQL twin."""

from __future__ import annotations

from wayfare.plans import board_q, build_q, facets_q, labels_q, links_q, spatial_q, timing_q

_MODULES = (facets_q, spatial_q, timing_q, board_q, links_q, labels_q, build_q)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
