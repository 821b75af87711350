"""Custom aggregates with partial states.

A custom aggregate is four functions: ``zero() -> state``, ``add(state, *values) -> state``,
``merge(state, state) -> state`` and ``finish(state) -> value``.  Each task adds its rows up to one
state per key; the states go through one exchange as bytes, in Arrow batches, and are
merged key by key in sorted order.  A key with much of the data gives one state per
task, and no task holds more than a bounded number of states.

A merge whose sources fan out counts a row once for each combination with the other
sources' rows.  ``merge`` can do that without making the combinations: a state merged with itself
``n`` times by doubling is what adding its rows ``n`` times gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, Mapping as TMapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policies import src_col
from ..session import ship_code
from ..spec import SpecError

#: States that a task holds before it gives them out.
HELD_STATES = 100_000


@dataclass(frozen=True)
class Aggregate:
    """The four functions, and the Spark type of the result.  ``merge`` must not depend on how rows were split;
    it and ``add`` may change their first argument and must return the state."""

    zero: Callable[[], Any]
    add: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    result: str

    def times(self, state: Any, n: int) -> Any:
        """``state`` as if each of its rows had come ``n`` times, by doubling."""
        out, power = self.zero(), state
        while n:
            if n & 1:
                out = self.merge(out, pickle.loads(pickle.dumps(power)))
            n >>= 1
            if n:
                power = self.merge(pickle.loads(pickle.dumps(power)), power)
        return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _partial(agg: Aggregate, n_keys: int):
    """Per task and key: the number of rows and their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        schema = None

        def give() -> pa.RecordBatch:
            rows = [(*k, n, pickle.dumps(s)) for k, (n, s) in states.items()]
            states.clear()
            return _batch(rows, schema)

        for b in batches:
            if schema is None:
                schema = pa.schema([*list(b.schema)[:n_keys], ("n", pa.int64()), ("state", pa.binary())])
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                held = states.get(row[:n_keys])
                if held is None:
                    held = states[row[:n_keys]] = [0, agg.zero()]
                held[0] += 1
                held[1] = agg.add(held[1], *row[n_keys:])
            if len(states) > HELD_STATES:
                yield give()
        if states:
            yield give()

    return run


def _merged(agg: Aggregate, n_keys: int):
    """States that come sorted by key, merged; one row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, state, schema = None, 0, None, None
        for b in batches:
            schema = schema or b.schema
            out = []
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                if key is None or row[:n_keys] != key:
                    if key is not None:
                        out.append((*key, rows, pickle.dumps(state)))
                    key, rows, state = row[:n_keys], 0, agg.zero()
                rows += row[n_keys]
                state = agg.merge(state, pickle.loads(row[n_keys + 1]))
            if out:
                yield _batch(out, schema)
        if key is not None:
            yield _batch([(*key, rows, pickle.dumps(state))], schema)

    return run


def partial_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], agg: Aggregate) -> DataFrame:
    """``<keys>, n, state``: one state per key, after one exchange of partial states."""
    ship_code(df.sparkSession)
    if clash := {"n", "state"} & set(keys):
        raise SpecError(f"key names are taken: {', '.join(sorted(clash))}")
    rows = df.select(*[src_col(k) for k in keys], *[src_col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*rows.schema.fields[: len(keys)], T.StructField("n", T.LongType()), T.StructField("state", T.BinaryType())])
    named = [src_col(k) for k in keys]
    return (rows.mapInArrow(_partial(agg, len(keys)), schema).repartition(*named).sortWithinPartitions(*named)
            .mapInArrow(_merged(agg, len(keys)), schema))


def aggregate_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], agg: Aggregate, name: str) -> DataFrame:
    """``<keys>, <name>``: the custom aggregate of ``columns`` per key.  Null keys are one key; an empty table gives no rows."""
    return _finished(partial_states(df, keys, columns, agg), list(keys), [], agg, name)


def _finished(states: DataFrame, keys: list[str], times: list[str], agg: Aggregate, name: str) -> DataFrame:
    """Finish each state, merged with itself as often as the product of the columns ``times`` says."""
    rows = states.select(*[src_col(k) for k in keys], "state", *times)
    schema = T.StructType([*rows.schema.fields[: len(keys)], *T.StructType.fromDDL(f"`{name}` {agg.result}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b in batches:
            values = []
            factors = [b.column(len(keys) + 1 + i).to_pylist() for i in range(len(times))]
            for i, s in enumerate(b.column(len(keys)).to_pylist()):
                n = reduce(lambda a, f: a * f, (f[i] for f in factors), 1)
                state = pickle.loads(s)
                values.append(agg.finish(state if n == 1 else agg.times(state, n)))
            kind = kind or _arrow_type(schema.fields[-1].dataType)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(values, kind)], [*keys, name])

    return rows.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fanned_aggregate(sources: TMapping[str, DataFrame], keys: TMapping[str, Sequence[str]], source: str, columns: Sequence[str],
                     agg: Aggregate, name: str) -> DataFrame:
    """The custom aggregate of one source's columns over the inner join of all ``sources`` on their ``keys``, without that join.

    Each source is aggregated on its key first: the one to its states, the others to their numbers
    of rows, which say how often each row of the first would come.  Rows with a null among their
    keys join nothing.  The result has the key names of ``source``.
    """
    own = list(keys[source])
    if any(len(k) != len(own) for k in keys.values()):
        raise SpecError("all sources need the same number of keys")

    def known(s: str) -> DataFrame:
        return sources[s].dropna(subset=list(keys[s]))

    out, times = partial_states(known(source), own, columns, agg), []
    for i, s in enumerate(x for x in sources if x != source):
        count = known(s).groupBy(*[src_col(k).alias(o) for k, o in zip(keys[s], own, strict=True)]).agg(F.count(F.lit(1)).alias(f"_times{i}"))
        out = out.join(count, own)
        times.append(f"_times{i}")
    return _finished(out, own, times, agg, name)
