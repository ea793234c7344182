"""The registered queries and their DuckDB oracles, collected from the plan modules."""

from __future__ import annotations

from fixlattice.plans import changes, checking, logs, nodes, rates, records

_MODULES = (rates, logs, changes, checking, nodes, records)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
