"""keymerge: merge messy tabular sources by key on Spark.

The whole public surface is importable from here::

    from keymerge import merge, MergeSpec, Mapping, Policy, SourceField
"""

from .functions.policies import custom
from .functions.predicates import (Contains, Equals, Expr, GreaterThan, IsNotNull, IsNull, LessThan, Not, Regex,
                                   filter_rows, select_columns)
from .functions.semantic import semantic_type
from .operators.entities import Link, components, entity_merge, link_pairs, resolve
from .operators.evidence import explain_entities, link_edges, link_paths
from .operators.incremental import changed_ids, changed_keys, or_state, remerge, remerge_changed, remerge_or
from .operators.lists import chunked_values, places
from .operators.merge import merge
from .operators.quality import coverage, lineage, unresolved, unresolved_entities
from .operators.aggregates import Aggregate, aggregate_by, fanned_aggregate
from .operators.clusters import bounded_components
from .operators.states import apply_changes, finish_states, merge_states
from .operators.timejoins import asof_join, interval_join, range_join
from .operators.types import (apply_types, cast_declared, infer_column_types, infer_types, profile, split_by_type,
                              type_ranges)
from .plans.explain import plan_report
from .plans.run import run_plan
from .plans.sqlmode import sql
from .sources import load_source, load_sources, parse_source, payload_csv, preview, read_csv, read_tsv, write
from .sources.pages import read_page, write_pages
from .spec import DestField, Mapping, MergeSpec, Policy, SourceDef, SourceField, SpecError, validate

__all__ = [
    # spec
    "DestField", "Mapping", "MergeSpec", "Policy", "SourceDef", "SourceField", "SpecError", "validate", "custom",
    # sources / sinks
    "load_source", "load_sources", "parse_source", "payload_csv", "preview", "read_csv", "read_tsv", "write",
    "read_page", "write_pages",
    # merge, SQL, plans
    "merge", "sql", "run_plan", "plan_report",
    # types
    "apply_types", "cast_declared", "infer_column_types", "infer_types", "profile", "semantic_type", "split_by_type",
    "type_ranges",
    # predicates
    "Contains", "Equals", "Expr", "GreaterThan", "IsNotNull", "IsNull", "LessThan", "Not", "Regex", "filter_rows",
    "select_columns",
    # entities
    "Link", "bounded_components", "components", "entity_merge", "link_pairs", "resolve",
    # ordered lists of keys of any size
    "chunked_values", "places",
    # custom aggregates with partial states
    "Aggregate", "aggregate_by", "fanned_aggregate",
    # joins along an ordered axis
    "asof_join", "interval_join", "range_join",
    # why rows are one entity
    "explain_entities", "link_edges", "link_paths",
    # quality and incremental
    "coverage", "lineage", "unresolved", "unresolved_entities", "changed_keys", "remerge", "remerge_changed",
    "or_state", "remerge_or", "changed_ids", "merge_states", "apply_changes", "finish_states",
]
