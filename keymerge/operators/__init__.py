"""DataFrame operators: merge, types, entities, quality, incremental."""
