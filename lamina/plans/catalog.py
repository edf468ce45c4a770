"""Registry of the queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import contours, details, fields, geometry, instances, outlines, registration, relations, splits, structures

MODULES = [structures, relations, fields, geometry, contours, splits, details, registration, instances, outlines]
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "qc_purity_recall"
