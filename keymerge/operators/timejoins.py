"""Joins along an ordered axis (J11): as-of, interval and range joins.

None of them compares all rows of a key with each other, and a key that holds much of the
data is spread over several tasks:

* ``asof_join`` sorts both sides together by key and time and carries the last right row
  along.  Keys with more than ``rows_per_task`` rows are cut into chunks of time at
  quantiles; what a chunk inherits from the chunks before it comes from a table with
  one row per chunk.  One exchange of each side.
* ``interval_join`` puts each interval into the bins, as wide as the next power of two, that
  it touches: two at most, however long it is.  A point looks into one bin per width in
  use.  The join is on (key, width, bin), which AQE can split.  Its pairs may be many more than
  its rows; so the rows of each (key, width, bin) are counted, and where all pairs are more than
  ``pairs_per_task`` each such group is cut into squares of bounded size, dealt over as many
  tasks as the pairs fill.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policies import src_col
from ..session import exchanged, materialize
from ..spec import SpecError

ROWS_PER_TASK = 1_000_000
PAIRS_PER_TASK = 16_000_000
_MICROS = 86_400_000_000


def _axis(df: DataFrame, column: str) -> Column:
    """The column as a whole number (or double) in the same order."""
    kind, c = dict(df.dtypes)[column], src_col(column)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("bigint")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return c.cast("double")
    if kind == "date":
        return F.unix_date(c).cast("bigint") * _MICROS
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # by its fields, so that no time zone enters
        seconds = F.hour(c) * 3600 + F.minute(c) * 60
        return (F.unix_date(c.cast("date")).cast("bigint") * _MICROS + seconds.cast("bigint") * 1_000_000
                + (F.expr(f"extract(SECOND FROM `{column.replace('`', '``')}`)") * 1_000_000).cast("bigint"))
    raise SpecError(f"cannot order by {column}: {kind}")


def _pack(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.struct(*[src_col(c).alias(f"c{i}") for i, c in enumerate(columns)])


def _unpack(packed: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{packed}.c{i}").alias(c) for i, c in enumerate(columns)]


def _names(left: DataFrame, right: DataFrame, left_keys, right_keys) -> list[str]:
    """The right side's columns in the result: all but keys of the same name."""
    if len(left_keys) != len(right_keys) or not left_keys:
        raise SpecError("both sides need the same number of keys, at least one")
    same = {r for le, r in zip(left_keys, right_keys) if le == r}
    names = [c for c in right.columns if c not in same]
    clash = sorted(set(names) & set(left.columns))
    if clash:
        raise SpecError(f"both sides have the columns {', '.join(clash)}: rename one")
    return names


def asof_join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Sequence[tuple[str, str]], left_time: str, right_time: str,
              how: str = "left", direction: str = "backward", allow_exact: bool = True, tie_by: str | Sequence[str] = (),
              tolerance: float | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before its time (``forward``: at or after).

    ``tie_by`` names right columns that order right rows of equal time: the last (``forward``: the
    first) is taken.  Without ``allow_exact`` equal times do not match.  ``tolerance`` is the greatest
    distance (microseconds for dates and timestamps, else the axis' unit).  Left rows without a
    match have nulls, or are left out with ``how="inner"``.  Null keys and times match nothing.
    """
    if how not in ("left", "inner") or direction not in ("backward", "forward"):
        raise SpecError("how must be left or inner, direction backward or forward")
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]
    lk, rk = [p[0] for p in pairs], [p[1] for p in pairs]
    names = _names(left, right, lk, rk)
    tie_by = [tie_by] if isinstance(tie_by, str) else list(tie_by)
    keys = [f"k{i}" for i in range(len(pairs))]
    at = [(F.lit(-1) if direction == "forward" else F.lit(1)) * _axis(d, c) for d, c in ((left, left_time), (right, right_time))]
    # Forward is backward along the negated axis; ties then go the other way round.
    tie = _pack(right, tie_by) if tie_by else F.lit(0)
    lrows = left.select(*[src_col(c).alias(k) for c, k in zip(lk, keys)], at[0].alias("t"), _pack(left, left.columns).alias("l"))
    rrows = right.select(*[src_col(c).alias(k) for c, k in zip(rk, keys)], at[1].alias("t"), tie.alias("tie"), _pack(right, names).alias("r"))
    known = F.col("t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rrows = rrows.filter(known)
    if direction == "forward" and tie_by:  # of equal times the first counts: only that row is kept
        rrows = rrows.groupBy(*keys, "t").agg(F.min_by("r", "tie").alias("r")).withColumn("tie", F.lit(0))
    # Chunks of the keys with many rows: bounds at quantiles of their times.
    times = lrows.filter(known).select(*keys, "t").unionByName(rrows.select(*keys, "t"))
    hot = materialize(times.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_task))
    chunked = not hot.isEmpty()
    if chunked:
        steps = -(-hot.agg(F.max("n")).first()[0] // rows_per_task)
        # One sketch per hot key with the quantiles that the hottest needs; a key takes as many of them as it has chunks.
        chunks = f"ceil(n / {rows_per_task})"
        bounds = (times.join(hot, keys).groupBy(*keys)
                  .agg(F.first("n").alias("n"), F.percentile_approx("t", [i / steps for i in range(1, steps)], max(10_000, 4 * steps)).alias("q"))
                  .withColumn("b", F.expr(f"array_distinct(transform(sequence(1, int({chunks}) - 1), i -> element_at(q, greatest(1, int(i * {steps} / {chunks})))))")))
        bounds = materialize(bounds.select(*keys, "b"))
        chunk = F.coalesce(F.size(F.filter("b", lambda x: x < F.col("t"))), F.lit(0))
        lrows = lrows.join(bounds, keys, "left").withColumn("chunk", F.when(F.col("b").isNull(), 0).otherwise(chunk)).drop("b")
        rrows = rrows.join(bounds, keys, "left").withColumn("chunk", F.when(F.col("b").isNull(), 0).otherwise(chunk)).drop("b")
    else:
        lrows, rrows = lrows.withColumn("chunk", F.lit(0)), rrows.withColumn("chunk", F.lit(0))
    # At equal times right rows come first, or last where equal times do not count.
    side = F.lit(0 if allow_exact else 2)
    both = (lrows.filter(known).select(*keys, "chunk", "t", F.lit(1).alias("side"), F.lit(None).cast(rrows.schema["tie"].dataType).alias("tie"), "l",
                                       F.lit(None).cast(rrows.schema["r"].dataType).alias("r"))
            .unionByName(rrows.select(*keys, "chunk", "t", side.alias("side"), "tie", F.lit(None).cast(lrows.schema["l"].dataType).alias("l"), "r")))
    run = Window.partitionBy(*keys, "chunk").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.struct(F.col("t").alias("at"), "r")
    found = both.withColumn("m", F.last(F.when(F.col("side") != 1, seen), ignorenulls=True).over(run)).filter(F.col("side") == 1)
    if chunked:  # the last right row of the chunks before, one row per chunk of a hot key
        ends = rrows.join(hot.select(*keys), keys, "left_semi").groupBy(*keys, "chunk").agg(F.max_by(seen, F.struct("t", "tie")).alias("end"))
        firsts = hot.select(*keys, F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / rows_per_task).cast("int"))).alias("chunk"))
        before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry = firsts.join(ends, [*keys, "chunk"], "left").withColumn("carry", F.last("end", ignorenulls=True).over(before)).drop("end")
        found = found.join(materialize(carry), [*keys, "chunk"], "left").withColumn("m", F.coalesce("m", "carry"))
    match = F.col("m")
    if tolerance is not None:
        match = F.when(F.col("t") - F.col("m.at") <= F.lit(tolerance), match)
    found = found.withColumn("m", match)
    if how == "inner":
        found = found.filter(F.col("m").isNotNull())
    out = found.select("l", F.col("m.r").alias("r"))
    if how == "left":
        out = out.unionByName(lrows.filter(~known).select("l", F.lit(None).cast(rrows.schema["r"].dataType).alias("r")))
    return out.select(*_unpack("l", left.columns), *_unpack("r", names))


# Widths of bins are 2 ** level; finer ones than this are not told apart for fractions.
_LEAST_LEVEL = -20


def interval_join(points: DataFrame, intervals: DataFrame, on: str | Sequence[str] | Sequence[tuple[str, str]], point: str,
                  start: str, end: str, how: str = "inner", pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Each point with every interval of its keys that holds it: ``start <= point <= end``.

    With ``how="left"`` points in no interval stay, with nulls.  Null keys, points and ends match
    nothing, and neither does an interval that ends before it starts.  A task compares about
    ``pairs_per_task`` points and intervals.
    """
    if how not in ("inner", "left"):
        raise SpecError("how must be inner or left")
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([on] if isinstance(on, str) else on)]
    pk, ik = [p[0] for p in pairs], [p[1] for p in pairs]
    names = _names(points, intervals, pk, ik)
    keys = [f"k{i}" for i in range(len(pairs))]
    p = points.select(*[src_col(c).alias(k) for c, k in zip(pk, keys)], _axis(points, point).alias("t"), _pack(points, points.columns).alias("l"))
    i = intervals.select(*[src_col(c).alias(k) for c, k in zip(ik, keys)], _axis(intervals, start).alias("s"), _axis(intervals, end).alias("e"),
                         _pack(intervals, names).alias("r")).filter("s <= e")
    kinds = {p.schema["t"].dataType.simpleString(), i.schema["s"].dataType.simpleString(), i.schema["e"].dataType.simpleString()}
    if len(kinds) > 1:  # whole numbers beside fractions
        p = p.withColumn("t", F.col("t").cast("double"))
        i = i.withColumn("s", F.col("s").cast("double")).withColumn("e", F.col("e").cast("double"))
    whole = kinds == {"bigint"}
    least = 0 if whole else _LEAST_LEVEL
    length = (F.col("e") - F.col("s")).cast("double")
    # Rounded up, and one more where the logarithm may have been rounded down.
    level = F.when(length <= 0, F.lit(least)).otherwise(F.greatest(F.lit(least), F.ceil(F.log2(length) + F.lit(1e-9)).cast("int")))
    i = i.withColumn("level", F.least(level, F.lit(63 if whole else 1000)))

    def bin_of(c: str, at: str) -> Column:
        if whole:
            return F.expr(f"if({at} >= 63, if({c} < 0, -1L, 0L), shiftright({c}, {at}))")
        return F.expr(f"floor({c} / power(2D, {at}))")

    i = i.withColumn("bin", F.explode(F.array_distinct(F.array(bin_of("s", "level"), bin_of("e", "level")))))
    levels = sorted(r[0] for r in i.select("level").distinct().collect())  # a number per power of two

    def looking(points: DataFrame) -> DataFrame:
        at = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))) if levels else points.withColumn("level", F.lit(0)).limit(0)
        return at.withColumn("bin", bin_of("t", "level"))

    on = [*keys, "level", "bin"]
    squares, tasks = _squares(looking(p), i, on, pairs_per_task)
    if how == "left" or squares is not None:  # numbers that a repeated task finds again
        p = materialize(p.withColumn("id", F.monotonically_increasing_id()))
    at = looking(p)
    if squares is not None:
        # A point looks into one row of squares, and an interval stands in one column.
        i = materialize(i.withColumn("id", F.monotonically_increasing_id()))
        at = (at.join(squares, on).withColumn("x", F.expr("pmod(xxhash64(id), across)")).withColumn("y", F.explode(F.expr("sequence(0L, down - 1)"))))
        i = i.join(squares, on).withColumn("y", F.expr("pmod(xxhash64(id), down)")).withColumn("x", F.explode(F.expr("sequence(0L, across - 1)")))
        on = [*on, "x", "y"]
        at, i = at.repartition(tasks, *on), exchanged(i.drop("id").repartition(tasks, *on))
    match = at.join(i, on).filter("t between s and e")
    if how == "inner":
        return match.select(*_unpack("l", points.columns), *_unpack("r", names))
    # Points in no interval: those whose number does not come up among the matches.
    alone = p.join(match.select("id").distinct(), "id", "left_anti").select("l", F.lit(None).cast(i.schema["r"].dataType).alias("r"))
    return match.select("l", "r").unionByName(alone).select(*_unpack("l", points.columns), *_unpack("r", names))


def _squares(points: DataFrame, intervals: DataFrame, on: list[str], pairs_per_task: int) -> tuple[DataFrame | None, int]:
    """For each (key, width, bin) with both, into how many parts its points (``across``) and intervals (``down``) go;
    and the number of tasks.  None where one task could take all pairs, or points meet few intervals each."""
    side = max(1, math.isqrt(pairs_per_task) // 2)
    held = materialize(intervals.groupBy(*on).agg(F.count(F.lit(1)).alias("down")))
    if (held.agg(F.max("down")).first()[0] or 0) <= side // 32:
        return None, 0
    groups = materialize(points.groupBy(*on).agg(F.count(F.lit(1)).alias("across")).join(held, on))
    pairs = groups.agg(F.sum(F.col("across").cast("double") * F.col("down"))).first()[0] or 0
    if pairs <= pairs_per_task:
        return None, 0
    tasks = max(math.ceil(pairs / pairs_per_task), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return groups.select(*on, *[F.ceil(F.col(c) / side).alias(c) for c in ("across", "down")]), tasks


def range_join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Sequence[tuple[str, str]], left_at: str, right_at: str,
               distance: float, how: str = "inner", pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Each left row with every right row of its keys at most ``distance`` away (microseconds for dates and
    timestamps, else the axis' unit): ``right_at - distance <= left_at <= right_at + distance``."""
    low, high, axis = "__low", "__high", "__at"
    wide = right.withColumns({low: _axis(right, right_at) - F.lit(distance), high: _axis(right, right_at) + F.lit(distance)})
    out = interval_join(left.withColumn(axis, _axis(left, left_at)), wide, on, axis, low, high, how, pairs_per_task)
    return out.drop(axis, low, high)
