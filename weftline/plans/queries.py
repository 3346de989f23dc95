"""The registered queries and their DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from . import compare, documents, folds, grids, logs, projects, readings, records, staging

QUERIES = {**grids.QUERIES, **logs.QUERIES, **records.QUERIES, **folds.QUERIES, **projects.QUERIES, **compare.QUERIES, **readings.QUERIES, **staging.QUERIES, **documents.QUERIES}
ORACLE = {**grids.ORACLE, **logs.ORACLE, **records.ORACLE, **folds.ORACLE, **projects.ORACLE, **compare.ORACLE, **readings.ORACLE, **staging.ORACLE, **documents.ORACLE}
