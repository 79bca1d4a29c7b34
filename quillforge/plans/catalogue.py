"""Registered queries over the given tables, with their DuckDB SQL."""

from __future__ import annotations

from quillforge.plans import catalog, eventlog, evidence, extractions, identity, ladders, linking, merging, metrics, profiles, reconcile, records, scalars, selections, statements, streams, structures, texts

_PARTS = (profiles, extractions, catalog, linking, merging, eventlog, evidence, identity, metrics, ladders, reconcile, texts, records, scalars, selections, statements, streams, structures)

QUERIES = {name: f for part in _PARTS for name, f in part.R.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.R.sql.items()}
