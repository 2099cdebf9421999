"""All queries and their SQL."""

from __future__ import annotations

from assayer.plans import case_queries, discovery_queries, document_queries, domain_queries, run_queries, text_queries, validation_queries, vote_queries

MODULES = (run_queries, vote_queries, text_queries, domain_queries, document_queries, discovery_queries, case_queries, validation_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
