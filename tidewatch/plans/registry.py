"""All named queries: name -> function of (session, table folder)."""

from __future__ import annotations

from tidewatch.plans import dashboard_queries, email_queries, evidence_queries, flow_queries, learning_queries, text_queries

_GROUPS = [dashboard_queries, text_queries, email_queries, evidence_queries, flow_queries, learning_queries]

QUERIES = {}
ORACLES = {}
for _group in _GROUPS:
    QUERIES.update(_group.QUERIES)
    ORACLES.update(_group.ORACLES)


def get_query(name: str):
    """The query of that name; an unknown name lists the known ones."""
    if name not in QUERIES:
        raise KeyError(f"unknown query {name!r}; known: {', '.join(sorted(QUERIES))}")
    return QUERIES[name]
