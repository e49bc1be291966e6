"""The registered queries of the calibration and drift operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.queries import calibration, files, monitoring, preparation, records

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for part in (calibration, monitoring, preparation, records, files):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
