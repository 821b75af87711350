"""Plan inspection: what a query will shuffle, broadcast, push down and run in Python.

``plan_report(df)`` reads the physical plan (the final AQE plan once the
DataFrame has run, the initial plan otherwise) and counts the operators that
matter at scale.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

_PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning|Exchange SinglePartition",
    "single_partition_exchanges": r"Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "sort_merge_joins": r"SortMergeJoin",
    "broadcast_hash_joins": r"BroadcastHashJoin",
    "nested_loop_joins": r"BroadcastNestedLoopJoin|CartesianProduct",
    "hash_aggregates": r"\bHashAggregate\(",
    "sort_aggregates": r"\bSortAggregate\(",
    "python_row_udfs": r"BatchEvalPython",
    "python_arrow_ops": r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|MapInArrow",
    "pushed_filter_scans": r"PushedFilters: \[[^\]]+\]",
}


def plan_text(df: DataFrame) -> str:
    """The physical plan as ``DataFrame.explain()`` prints it (final AQE plan once run)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    # After execution AQE prints the final plan, then the initial one: keep the final.
    return buf.getvalue().split("== Initial Plan ==")[0]


def _unbounded_single_partition(text: str) -> int:
    """Single-partition exchanges whose input is not a partial aggregate.

    A global aggregate sends one partial row per task to one partition, which
    is bounded by the task count; anything else funnels data into one task.
    """
    lines = [ln for ln in text.splitlines() if ln.strip()]
    n = 0
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("Aggregate(" in nxt and "partial_" in nxt):
                n += 1
    return n


def plan_report(df: DataFrame) -> dict[str, int]:
    text = plan_text(df)
    out = {k: len(re.findall(p, text)) for k, p in _PATTERNS.items()}
    out["unbounded_single_partition"] = _unbounded_single_partition(text)
    return out
