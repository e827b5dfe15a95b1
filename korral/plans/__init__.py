"""Registered queries over the test tables, and their DuckDB oracles."""

from korral.plans import analysis, workflow

QUERIES = analysis.QUERIES | workflow.QUERIES
ORACLES = analysis.ORACLES | workflow.ORACLES
