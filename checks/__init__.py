"""Registered queries, their DuckDB counterparts, and the plain form used for comparison."""
