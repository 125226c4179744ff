"""All registered queries: importing the modules below fills the registry."""

from __future__ import annotations

from lectern.plans import analysis_queries, corpus_queries, retrieval_queries, rule_queries
from lectern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis_queries", "corpus_queries", "retrieval_queries", "rule_queries"]
