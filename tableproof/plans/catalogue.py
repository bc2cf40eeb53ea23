"""All registered queries."""

from tableproof.plans import (
    certify_queries,
    governance_queries,
    hashtree_queries,
    inference_queries,
    lineage_queries,
    load_queries,
    mart_queries,
    merge_queries,
    parity_queries,
    sample_queries,
    stream_queries,
)
from tableproof.plans.parity_queries import flagship
from tableproof.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "certify_queries", "flagship", "governance_queries", "hashtree_queries", "inference_queries", "lineage_queries", "load_queries", "mart_queries",
    "merge_queries", "parity_queries", "sample_queries", "stream_queries",
]
