"""Readers and writers."""

from .readers import ORD, load_source, load_sources, parse_source, payload_csv, read_csv, read_tsv, with_ordinal
from .sinks import preview, preview_text, write

__all__ = ["ORD", "load_source", "load_sources", "parse_source", "payload_csv", "read_csv", "read_tsv",
           "with_ordinal", "preview", "preview_text", "write"]
