"""All registered queries and their SQL."""

from __future__ import annotations

from gridloom import queries, queries_geometry, queries_graphs, queries_jobs, queries_lookups, queries_sources, queries_stages  # noqa: F401  (each module registers its own)

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
