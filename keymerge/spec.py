"""Merge specification: sources, destination schema, keys and mappings.

The spec is plain Python objects.  ``MergeSpec.from_dict`` accepts the three
JSON plan dialects seen in the wild (flat, nested under ``query``, and
externally tagged sources) so an existing plan file can be loaded with
``json.load`` + ``from_dict``.  Validation runs on the driver only and never
touches data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Callable, Sequence

# Policy names.  The first group is the documented meaning of each policy;
# the second group reproduces the literal row-level behaviour of the original
# engine (see README, "policy semantics").
DOCUMENTED_POLICIES = ("firstMatch", "lastMatch", "sum", "count", "average", "min", "max", "concat", "custom")
LITERAL_POLICIES = ("first_row", "row_sum", "count_rows", "row_means", "values", "coalesced_values")
ALL_POLICIES = DOCUMENTED_POLICIES + LITERAL_POLICIES

_POLICY_ALIASES = {
    "firstmatch": "firstMatch", "first_match": "firstMatch", "first": "firstMatch",
    "lastmatch": "lastMatch", "last_match": "lastMatch", "last": "lastMatch",
    "sum": "sum", "count": "count", "average": "average", "avg": "average", "mean": "average",
    "min": "min", "max": "max", "concat": "concat", "concatenate": "concat", "custom": "custom",
    "first_row": "first_row", "firstrow": "first_row", "row_sum": "row_sum", "count_rows": "count_rows",
    "row_means": "row_means", "values": "values", "coalesced_values": "coalesced_values",
}

# Declared destination type names accepted by ``cast=True`` (fixed values).
TYPE_NAMES = {
    "Int64": "bigint", "Integer": "bigint", "integer": "bigint", "int": "bigint", "long": "bigint",
    "Float64": "double", "Float": "double", "float": "double", "number": "double", "double": "double",
    "String": "string", "string": "string", "str": "string", "text": "string",
    "Boolean": "boolean", "boolean": "boolean", "bool": "boolean",
}


# User-visible error texts kept identical to the original tool's,
# so scripts that match on them keep working.
MESSAGES = {
    "no_sources": "QueryPlan must have at least one data source",
    "no_mappings": "DSL QueryPlan must have at least one field mapping",
    "no_keys": "DSL QueryPlan must have at least one primary key",
    "unknown_source": "Mapping references unknown source: {}",
    "unknown_key_field": "Primary key references unknown destination field: {}",
    "empty_sql": "SQL query cannot be empty",
    "unmapped_key": "No mapping found for primary key: {}",
    "no_fields": "Mapping has no source fields",
    "file_not_found": "File not found: {}",
    "unsupported_format": "Unsupported format: {}",
}


class SpecError(ValueError):
    """Raised when a merge spec is inconsistent (driver-side check)."""


def msg(key: str, *args) -> str:
    return MESSAGES[key].format(*args)


@dataclass(frozen=True)
class SourceField:
    source: str
    column: str


_CUSTOM: dict[str, Callable[..., Any]] = {}


def register_function(name: str, func: Callable[..., Any]) -> None:
    """Give a custom merge function (field Columns -> aggregate Column) the name that plans use."""
    _CUSTOM[name] = func


def custom_function(name: str) -> Callable[..., Any]:
    """A registered function, or Spark's aggregate function of that name."""
    if name in _CUSTOM:
        return _CUSTOM[name]
    from pyspark.sql import functions as F

    return lambda *cols: F.call_function(name, *cols)


@dataclass(frozen=True)
class Policy:
    kind: str = "firstMatch"
    priority: tuple[str, ...] = ()
    sep: str = ","
    func: Callable[..., Any] | None = None

    def __post_init__(self):
        canon = _POLICY_ALIASES.get(self.kind, _POLICY_ALIASES.get(str(self.kind).lower()))
        if canon is None:
            raise SpecError(f"Unknown merge policy: {self.kind}")
        object.__setattr__(self, "kind", canon)
        object.__setattr__(self, "priority", tuple(self.priority))
        if canon == "custom" and self.func is None:
            raise SpecError("custom policy needs func")
        if isinstance(self.func, str):
            object.__setattr__(self, "func", custom_function(self.func))


@dataclass(frozen=True)
class Mapping:
    destination: str
    policy: Policy
    fields: tuple[SourceField, ...]

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    def ordered_fields(self) -> list[SourceField]:
        """Fields in priority order: sources named in ``priority`` first, then listed order."""
        pri = list(self.policy.priority)
        if not pri:
            return list(self.fields)
        rank = {s: i for i, s in enumerate(pri)}
        idx = sorted(range(len(self.fields)), key=lambda i: (rank.get(self.fields[i].source, len(pri)), i))
        return [self.fields[i] for i in idx]


@dataclass(frozen=True)
class DestField:
    name: str
    data_type: str = "String"


@dataclass(frozen=True)
class SourceDef:
    """A source to be read (``sources.readers.load_sources``)."""

    id: str
    path: str
    format: str = "csv"
    options: tuple[tuple[str, str], ...] = ()
    data: str | None = None  # the text itself, for a source that is held in the plan


@dataclass
class MergeSpec:
    destination: list[DestField]
    keys: list[str]
    mappings: list[Mapping]
    logic: str = "and"
    sources: list[SourceDef] = field(default_factory=list)

    # ------------------------------------------------------------------ build
    @staticmethod
    def build(keys: Sequence[str], mappings: Sequence[Mapping], destination: Sequence[DestField | str] | None = None,
              logic: str = "and", sources: Sequence[SourceDef] = ()) -> "MergeSpec":
        if destination is None:
            destination = [m.destination for m in mappings]
        dest = [d if isinstance(d, DestField) else DestField(d) for d in destination]
        return MergeSpec(dest, list(keys), list(mappings), logic.lower(), list(sources))

    @staticmethod
    def from_dict(d: dict) -> "MergeSpec":
        """Accept flat, ``query``-nested and externally-tagged plan dialects."""
        outer = d
        if "query" in d and isinstance(d["query"], dict):
            d = d["query"]
            if "Dsl" in d and isinstance(d["Dsl"], dict):
                d = d["Dsl"]
        sources = [_source_from_dict(s) for s in (d.get("sources") or outer.get("sources") or [])]
        dest = [DestField(f["name"], f.get("data_type", "String")) for f in d.get("destination_schema", [])]
        pk = d.get("primary_keys", d.get("primary_key", {}))
        if isinstance(pk, list):
            keys, logic = pk, "and"
        else:
            keys, logic = list(pk.get("keys", [])), str(pk.get("logic", "and")).lower()
        mappings = []
        for m in d.get("mappings", []):
            pol = m.get("policy", {"type": "firstMatch"})
            if isinstance(pol, str):
                pol = {"type": pol}
            policy = Policy(pol.get("type", "firstMatch"), tuple(pol.get("priority", ()) or ()),
                            pol.get("separator", pol.get("sep", ",")), pol.get("function", pol.get("func")))
            flds = tuple(SourceField(f["source_file_id"], f["column_name"]) for f in m.get("source_fields", []))
            mappings.append(Mapping(m["destination_field"], policy, flds))
        return MergeSpec(dest, keys, mappings, logic, sources)

    # --------------------------------------------------------------- helpers
    def mapping_for(self, name: str) -> Mapping | None:
        for m in self.mappings:
            if m.destination == name:
                return m
        return None

    def key_mappings(self) -> list[Mapping]:
        out = []
        for k in self.keys:
            m = self.mapping_for(k)
            if m is None:
                raise SpecError(msg("unmapped_key", k))
            if not m.fields:
                raise SpecError(msg("no_fields"))
            out.append(m)
        return out

    def value_mappings(self) -> list[Mapping]:
        return [m for m in self.mappings if m.destination not in self.keys]

    def joined_sources(self) -> list[str]:
        """Sources of the first key mapping, in listed order (primary first)."""
        seen: list[str] = []
        for f in self.key_mappings()[0].fields:
            if f.source in seen:
                raise SpecError(f"Source {f.source} appears twice in the key mapping")
            seen.append(f.source)
        return seen

    def key_columns(self) -> dict[str, dict[str, str]]:
        """source -> {destination key -> source column}."""
        out: dict[str, dict[str, str]] = {}
        for m in self.key_mappings():
            for f in m.fields:
                out.setdefault(f.source, {})[m.destination] = f.column
        return out


def _source_from_dict(s: dict) -> SourceDef:
    kind = next(iter(s)) if len(s) == 1 and next(iter(s)) in ("File", "Url", "Blob") else ""
    if kind:
        s = s[kind]
    data = s.get("data", s.get("bytes", s.get("content")))
    if kind == "Blob" or data is not None:
        if data is None:
            raise SpecError(f"Blob source {s.get('id')} has no data")
        text = data if isinstance(data, str) else bytes(data).decode("utf-8")
        return SourceDef(s["id"], "", str(s.get("format", "csv")), data=text)
    loc = s.get("path") or s.get("url") or s.get("uri") or ""
    return SourceDef(s["id"], loc, str(s.get("format", "csv")))


def validate(spec: MergeSpec, source_ids: Sequence[str] | None = None) -> None:
    """Driver-side checks; messages follow the original engine's wording."""
    ids = list(source_ids) if source_ids is not None else [s.id for s in spec.sources]
    if not ids:
        raise SpecError(msg("no_sources"))
    if not spec.mappings:
        raise SpecError(msg("no_mappings"))
    if not spec.keys:
        raise SpecError(msg("no_keys"))
    for m in spec.mappings:
        for f in m.fields:
            if f.source not in ids:
                raise SpecError(msg("unknown_source", f.source))
    dest_names = [d.name for d in spec.destination]
    for name in dest_names + [m.destination for m in spec.mappings]:
        if "." in name or "`" in name:
            raise SpecError(f"Destination field names may not contain '.' or '`': {name}")
    for k in spec.keys:
        if dest_names and k not in dest_names:
            raise SpecError(msg("unknown_key_field", k))
    if spec.logic not in ("and", "or"):
        raise SpecError(f"Unknown key logic: {spec.logic}")
    for m in spec.mappings:
        if not m.fields:
            raise SpecError(msg("no_fields"))
    km = spec.key_mappings()
    if spec.logic == "and":
        joined = spec.joined_sources()
        for m in km[1:]:
            srcs = [f.source for f in m.fields]
            for s in joined:
                if s not in srcs:
                    raise SpecError(f"Source {s} has no column for key {m.destination}")
        for m in spec.value_mappings():
            for f in m.fields:
                if f.source not in joined:
                    raise SpecError(f"Mapping {m.destination} reads source {f.source}, which is not joined by the key")


def validate_sql(text: str) -> None:
    if not text or not text.strip():
        raise SpecError(msg("empty_sql"))
