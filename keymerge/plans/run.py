"""Run a JSON plan as written for the original tool: sources + a DSL merge or SQL text.

``run_plan`` is the library form of the CLI's ``file`` / ``run`` commands:
sources are read (CSV/TSV typed by inference, or any Spark format), then the
DSL query is merged or the SQL text is executed over the sources by id.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.merge import merge
from ..sources.readers import load_sources
from ..spec import MergeSpec, SourceDef, SpecError, msg, validate
from .sqlmode import sql


def _sql_text(plan: dict) -> str | None:
    q = plan.get("query", plan)
    if isinstance(q, str):
        return q
    if isinstance(q, dict):
        if str(q.get("type", "")).lower() == "sql":
            return q.get("sql", "")
        if "Sql" in q and isinstance(q["Sql"], dict):
            return q["Sql"].get("sql", "")
    return None


def run_plan(spark: SparkSession, plan: dict | str, base_dir: str | None = None, **merge_kw) -> DataFrame:
    """Execute a plan dict (or a path to a JSON plan file).  Relative source paths
    resolve against ``base_dir`` (default: the plan file's folder, else the CWD)."""
    if isinstance(plan, str):
        if not os.path.exists(plan):
            raise SpecError(msg("file_not_found", plan))
        base_dir = base_dir or os.path.dirname(os.path.abspath(plan))
        with open(plan, encoding="utf-8") as fh:
            plan = json.load(fh)
    spec = MergeSpec.from_dict(plan)
    defs = [s if s.data is not None or "://" in s.path or os.path.isabs(s.path) or not base_dir
            else SourceDef(s.id, os.path.join(base_dir, s.path), s.format, s.options) for s in spec.sources]
    if not defs:
        raise SpecError(msg("no_sources"))
    text = _sql_text(plan)
    if text is not None:
        return sql(load_sources(spark, defs), text, spark)
    if "how" not in merge_kw and isinstance(plan, dict) and plan.get("how"):
        merge_kw["how"] = plan["how"]
    validate(spec, [d.id for d in defs])
    return merge(load_sources(spark, defs), spec, **merge_kw)
