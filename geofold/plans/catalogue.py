"""Registered queries over the test tables and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from geofold.plans import files, geometry, measures, meshes, neighbours, pixels, scenes, views

_PARTS = (measures, geometry, neighbours, meshes, pixels, scenes, views, files)
QUERIES = {name: q for part in _PARTS for name, q in part.BOOK.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.BOOK.sql.items()}
