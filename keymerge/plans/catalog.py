"""Registered acceptance queries: one per operator of the inventory.

Every query reads the driver's parquet tables (or data Spark derives from
them) in full, and comes with the equivalent DuckDB SQL where one exists.
"""

# Registration order = bench order: the core merge queries first.
from . import merge_queries  # noqa: F401,I001  (registration side effects)
from . import type_queries, io_queries, entity_queries, quality_queries, hard_queries, join_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
