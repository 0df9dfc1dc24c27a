"""All queries of the engine by name."""

from tabulon.plans import assembly_queries, catalog_queries, cube_queries, log_queries, record_queries, scalar_queries, streaming_queries
from tabulon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assembly_queries", "catalog_queries", "cube_queries", "log_queries", "record_queries", "scalar_queries", "streaming_queries"]
