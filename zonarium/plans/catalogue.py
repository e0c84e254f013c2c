"""All queries over the reference's operators, by name, with their oracles."""

from __future__ import annotations

from zonarium.plans import consult_queries, document_queries, event_queries, index_queries, more_queries, ordinance_queries, place_queries, planning_queries, retrieval_queries, rule_queries

_MODULES = (retrieval_queries, event_queries, rule_queries, document_queries, more_queries, ordinance_queries, planning_queries, place_queries, index_queries, consult_queries)

QUERIES: dict = {name: q for m in _MODULES for name, q in m.R.queries.items()}
ORACLE_SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.R.sql.items()}
FLAGSHIP = "bm25_topk"
