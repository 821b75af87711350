"""Column-level building blocks: merge policies, predicates, semantic types."""
