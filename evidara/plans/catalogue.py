"""All registered queries of the library without the corpus operators."""

from evidara.plans import evidence_queries, fact_queries, grounding_queries, label_queries, provenance_queries, record_queries, retrieval_queries, rule_queries, structure_queries, text_queries, usage_queries  # noqa: F401  registered on import
from evidara.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
