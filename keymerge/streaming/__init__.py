"""Structured Streaming front-end for incremental re-merge."""

from .remerge_stream import current_table, remerge_stream, upsert_batch

__all__ = ["current_table", "remerge_stream", "upsert_batch"]
