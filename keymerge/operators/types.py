"""Type inference and profiling.

* ``infer_types`` / ``apply_types`` (T1-T4): one aggregate job decides, per
  string column, the narrowest rung (boolean -> bigint -> double -> string) that
  every non-null value matches.  Nulls are neutral; an all-null column stays a
  string.  Only that one summary row reaches the driver (the schema must be
  known to build the cast).
* ``profile`` (T5/T6): semantic type per value, counted per column with the
  share of each type; a column holding two or more types is *mixed*.
* ``split_by_type`` (T8): one virtual column per type of a mixed column.
* ``type_ranges`` (T7): runs of consecutive rows holding one type, computed with
  range partitions, a per-partition pass and a stitch over the (tiny)
  per-partition edge table - never a window over the whole table.
* ``cast_declared`` (T9): ``try_cast`` to a declared type with the mismatches
  flagged.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policies import src_col
from ..functions.semantic import DATE_RUNGS, INFER_RUNGS, SEMANTIC_TYPES, semantic_type


def _string_cols(df: DataFrame, columns: list[str] | None) -> list[str]:
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    return [c for c in cols if kinds[c] == "string"]


def _rungs(parse_dates: bool) -> list[tuple[str, str]]:
    return INFER_RUNGS + (DATE_RUNGS if parse_dates else [])


# Whole numbers up to here are exact as doubles.
_EXACT = 2**53


def _kinds(parse_dates: bool) -> dict[str, int]:
    """The bit of each rung, and those of wide whole numbers (beyond what a double holds) and of text."""
    return {n: 1 << i for i, n in enumerate([*[n for n, _ in _rungs(parse_dates)], "wide", "string"])}


def _kind(v: Column, parse_dates: bool) -> Column:
    """The bit of the first rung a value matches, as one short-circuit CASE per value; null stays null.

    Whole numbers beyond 64 bits match no rung: as doubles they would lose digits.
    """
    bits = _kinds(parse_dates)
    e = F.when(v.isNull(), F.lit(None).cast("int"))
    for name, pat in _rungs(parse_dates):
        bit = F.lit(bits[name])
        if name == "bigint":  # up to 15 digits a whole number is exact; only longer ones are converted
            n = v.try_cast("bigint")
            bit = F.when(F.length(v) <= 15, bit).when(n.isNull(), F.lit(bits["string"])).when(n.between(-_EXACT, _EXACT), bit).otherwise(F.lit(bits["wide"]))
        e = e.when(v.rlike(pat), bit)
    return e.otherwise(F.lit(bits["string"]))


def _kind_aggs(cols: list[str], parse_dates: bool) -> list[Column]:
    """Per column which kinds of values it holds, and how many."""
    aggs = []
    for c in cols:
        aggs += [F.bit_or(_kind(src_col(c), parse_dates)).alias(f"{c}__r__kinds"), F.count(src_col(c)).alias(f"{c}__r__n")]
    return aggs


def _fits(parse_dates: bool) -> list[tuple[str, int, int]]:
    """``(type, needed, allowed)``: a column gets the type if it holds one of the needed kinds and none but the allowed ones."""
    bits = _kinds(parse_dates)
    out = []
    for n, _ in _rungs(parse_dates):
        needed = bits["bigint"] | bits["wide"] if n == "bigint" else bits[n]
        out.append((n, needed, needed | bits["bigint"] if n == "double" else needed))
    return out


def _winner(row: dict, c: str, parse_dates: bool) -> str:
    kinds = row.get(f"{c}__r__kinds") or 0
    return next((n for n, needed, allowed in _fits(parse_dates) if kinds & needed and not kinds & ~allowed), "string")


def infer_column_types(df: DataFrame, columns: list[str] | None = None, sample: int | None = None,
                       parse_dates: bool = False) -> dict[str, str]:
    """``{column: spark type}`` for the string columns of ``df``.

    ``sample`` limits inference to the first ``n`` rows (the limit reaches the
    scan); by default every row is inspected, so one bad token anywhere makes
    the column a string.  Types are lossless: whole numbers beyond 64 bits stay
    strings, and so do columns mixing fractions with whole numbers that a double
    cannot hold.
    """
    cols = _string_cols(df, columns)
    if not cols:
        return {}
    src = df.limit(sample) if sample else df
    row = src.agg(*_kind_aggs(cols, parse_dates)).first().asDict()
    return {c: _winner(row, c, parse_dates) for c in cols}


def cast_to(c: str, t: str) -> Column:
    """The column as type ``t``; values that do not fit become null."""
    v = src_col(c)
    if t == "boolean":
        low = F.lower(v)
        return F.when(low == F.lit("true"), True).when(low == F.lit("false"), False).alias(c)
    if t == "string":
        return v.alias(c)
    return v.try_cast(t).alias(c)


def apply_types(df: DataFrame, sample: int | None = None, schema_hint: dict[str, str] | None = None,
                parse_dates: bool = False, columns: list[str] | None = None, on_mismatch: str = "raise") -> DataFrame:
    """Cast string columns to their inferred type; ``schema_hint`` wins.

    Declared names (``Int64``, ``Boolean``, ...) and Spark types both serve as hints.
    Types found on a ``sample`` and hinted types may not fit every value.  No value is
    lost silently: with ``on_mismatch="raise"`` the job fails at the first one (checked while
    casting, no further pass), with ``"flag"`` it becomes null and ``<column>__mismatch`` true.
    """
    from ..spec import TYPE_NAMES

    if on_mismatch not in ("raise", "flag"):
        raise ValueError("on_mismatch must be raise or flag")
    hint = {c: TYPE_NAMES.get(t, t) for c, t in (schema_hint or {}).items()}
    kinds = dict(df.dtypes)
    todo = [c for c in _string_cols(df, columns) if c not in hint]
    types = infer_column_types(df, todo, sample, parse_dates) if todo else {}
    unsure = [c for c in kinds if kinds[c] == "string" and (c in hint or sample and c in types)]
    types.update(hint)
    out = []
    for c in df.columns:
        if c not in types:
            out.append(src_col(c))
            continue
        typed = cast_to(c, types[c]) if kinds[c] == "string" else src_col(c).try_cast(types[c]).alias(c)
        if c in unsure and types[c] != "string":
            lost = src_col(c).isNotNull() & typed.isNull()
            if on_mismatch == "raise":
                said = F.concat(F.lit(f"column {c}: not a {types[c]}: "), src_col(c))
                typed = F.when(lost, F.raise_error(said).cast(types[c])).otherwise(typed).alias(c)
            else:
                out.append(lost.alias(f"{c}__mismatch"))
        out.append(typed)
    return df.select(*out)


def infer_types(df: DataFrame, columns: list[str] | None = None, sample: int | None = None,
                parse_dates: bool = False) -> DataFrame:
    """Schema listing ``(position, column, dtype, n_values)`` as a lazy DataFrame.

    String columns get their inferred type; other columns keep theirs.
    Everything is one aggregate plus an ``inline`` - nothing is collected.
    """
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    src = df.limit(sample) if sample else df
    scols = [c for c in cols if kinds[c] == "string"]
    others = [c for c in cols if c not in scols]
    row = src.agg(*_kind_aggs(scols, parse_dates), *[F.count(src_col(c)).alias(f"{c}__r__n") for c in others])
    entries = []
    for i, c in enumerate(cols):
        if c in scols:
            found = F.coalesce(src_col(f"{c}__r__kinds"), F.lit(0))
            dtype = F.lit("string")
            for n, needed, allowed in reversed(_fits(parse_dates)):
                dtype = F.when((found.bitwiseAND(F.lit(needed)) != 0) & (found.bitwiseAND(F.lit(~allowed)) == 0), F.lit(n)).otherwise(dtype)
        else:
            dtype = F.lit(kinds[c])
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), dtype.alias("dtype"),
                                src_col(f"{c}__r__n").alias("n_values")))
    return row.select(F.inline(F.array(*entries)))


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    """T2 without a job: ``(name, dtype)`` of an already-typed DataFrame."""
    return list(df.dtypes)


def _long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    arr = F.array(*[F.struct(F.lit(c).alias("column"), src_col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(arr).alias("_x")).select(*keep, "_x.column", "_x.value")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, semantic_type, n, share, n_types, is_mixed)``.

    Values are unpivoted and typed on the executors, counted with a partial
    aggregate; the share uses a window over the aggregated table only (at most
    columns x types rows).  A column whose values are all null is reported
    once with type ``unknown``.
    """
    cols = columns or df.columns
    st = semantic_type("value")
    # Five-digit integers are set aside: they count as postcodes (ZIP codes) in a column that
    # also holds real postcode shapes, else as integers.  Decided on the count table below.
    # The ladder runs once per value: types and five-digit shapes are counted together first.
    typed = _long_values(df, cols).select("column", st.alias("_t"), F.col("value").rlike(r"^[0-9]{5}$").alias("_five"))
    zip5 = F.when((F.col("_t") == F.lit("integer")) & F.col("_five"), F.lit("_zip5")).otherwise(F.col("_t"))
    raw = typed.groupBy("column", "_t", "_five").agg(F.count(F.lit(1)).alias("n")).select("column", zip5.alias("semantic_type"), "n")
    has_post = F.max(F.when(F.col("semantic_type") == F.lit("postcode"), F.lit(1)).otherwise(F.lit(0))).over(
        Window.partitionBy("column"))  # over the count table: at most columns x types rows
    counts = (raw.withColumn("_post", has_post)
              .withColumn("semantic_type", F.when(F.col("semantic_type") == F.lit("_zip5"),
                                                  F.when(F.col("_post") == 1, F.lit("postcode")).otherwise(F.lit("integer")))
                          .otherwise(F.col("semantic_type")))
              .groupBy("column", "semantic_type").agg(F.sum("n").alias("n")))
    known = counts.filter(F.col("semantic_type").isNotNull())
    w = Window.partitionBy("column")
    known = (known.withColumn("_tot", F.sum("n").over(w))
             .withColumn("share", F.col("n") / F.col("_tot"))
             .withColumn("n_types", F.count(F.lit(1)).over(w))
             .withColumn("is_mixed", F.col("n_types") >= 2)
             .drop("_tot"))
    unknown = (counts.groupBy("column").agg(F.count(F.col("semantic_type")).alias("_k"))
               .filter(F.col("_k") == 0)
               .select("column", F.lit("unknown").alias("semantic_type"), F.lit(0).cast("bigint").alias("n"),
                       F.lit(None).cast("double").alias("share"), F.lit(0).cast("bigint").alias("n_types"),
                       F.lit(False).alias("is_mixed")))
    return known.unionByName(unknown)


def split_by_type(df: DataFrame, column: str, types: list[str] | None = None) -> DataFrame:
    """``<column>__<type>`` holds the value where it is of that type, else null.

    With ``types=None`` the types present are found by one small aggregate
    (bounded by the fixed ladder, at most a dozen names).
    """
    st = semantic_type(column)
    if types is None:
        present = {r[0] for r in df.select(st.alias("t")).filter(F.col("t").isNotNull()).distinct().collect()}
        types = [t for t in SEMANTIC_TYPES if t in present]
    return df.withColumns({f"{column}__{t}": F.when(st == F.lit(t), src_col(column)) for t in types})


def cast_declared(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """``try_cast`` each column to its declared type; ``<col>__mismatch`` flags failures."""
    from ..spec import TYPE_NAMES

    out = df
    for c, declared in casts.items():
        t = TYPE_NAMES.get(declared, declared)
        casted = src_col(c).try_cast(t)
        out = out.withColumns({f"{c}__cast": casted,
                               f"{c}__mismatch": src_col(c).isNotNull() & casted.isNull()})
    return out


# ---------------------------------------------------------------------------- T7
_RUN_SCHEMA = T.StructType([
    T.StructField("_pid", T.IntegerType()),
    T.StructField("_seq", T.LongType()),
    T.StructField("_start", T.LongType()),
    T.StructField("_len", T.LongType()),
    T.StructField("semantic_type", T.StringType()),
])


def _local_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal type inside one sorted partition (vectorised per Arrow batch).

    The last run of a batch may continue into the next batch, so it is held
    back and merged with the next batch's first run when the types agree.
    """
    cols = [f.name for f in _RUN_SCHEMA.fields]
    pid, seq, pos = None, 0, 0
    open_run: list | None = None  # [start, length, type] of the run still open
    for pdf in batches:
        if pdf.empty:
            continue
        if pid is None:
            pid = int(pdf["_pid"].iat[0])
        t = pdf["_t"].astype(object).where(pdf["_t"].notna(), None)
        key = t.fillna("\u0000null")
        change = key.ne(key.shift())
        change.iat[0] = True
        run_id = change.cumsum()
        grp = pd.DataFrame({"run": run_id.to_numpy(), "i": range(pos, pos + len(pdf)), "t": t.to_numpy()})
        runs = grp.groupby("run", sort=True).agg(start=("i", "min"), length=("i", "size"), t=("t", "first"))
        starts, lengths, types = runs["start"].tolist(), runs["length"].tolist(), runs["t"].tolist()
        if open_run is not None and open_run[2] == types[0]:
            lengths[0] += open_run[1]
            starts[0] = open_run[0]
            open_run = None
        done = []
        if open_run is not None:
            done.append((pid, seq, open_run[0], open_run[1], open_run[2]))
            seq += 1
        for a, n, ty in zip(starts[:-1], lengths[:-1], types[:-1]):
            done.append((pid, seq, a, n, ty))
            seq += 1
        open_run = [starts[-1], lengths[-1], types[-1]]
        pos += len(pdf)
        if done:
            yield pd.DataFrame(done, columns=cols)
    if open_run is not None:
        yield pd.DataFrame([(pid, seq, open_run[0], open_run[1], open_run[2])], columns=cols)


def type_ranges(df: DataFrame, column: str, order_by: str, partitions: int | None = None, penalty: int | None = None) -> DataFrame:
    """``(column, start_row, end_row, n_rows, semantic_type, confidence)``.

    Rows are numbered 1.. in ``order_by`` order (must be unique).  Plan:
    range-partition on the order column and sort inside partitions; a
    ``mapInPandas`` pass emits the runs of each partition with local offsets;
    partition offsets come from per-partition row counts (one row per
    partition, so its size is bounded by the partition count, not the data);
    runs that continue across a partition edge are stitched by a small window
    over that same per-partition table.  A run is pure, so confidence is 1.0.

    With ``penalty`` ranges tolerate stray values: the column is divided so that strays and
    ``penalty`` per change of type are fewest together, and ``confidence`` is the share of the
    type among its range's values (``segments.noisy_ranges``).
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = (df.select(F.col(order_by).alias("_o"), semantic_type(column).alias("_t"))
         .repartitionByRange(p, "_o").sortWithinPartitions("_o")
         .select(F.spark_partition_id().alias("_pid"), "_t"))
    # The runs feed two branches (edge table, final stitch); checkpoint them so the
    # Python pass runs once and lineage stays short.
    from ..session import materialize

    runs = materialize(t.mapInPandas(_local_runs, _RUN_SCHEMA), "runs")
    edges = runs.groupBy("_pid").agg(
        F.sum("_len").alias("_rows"), F.max("_seq").alias("_last_seq"),
        F.min_by("semantic_type", "_seq").alias("_first_t"), F.max_by("semantic_type", "_seq").alias("_last_t"))
    w = Window.orderBy("_pid")  # over one row per partition: bounded by the partition count
    edges = (edges
             .withColumn("_offset", F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_prev_last_t", F.lag("_last_t").over(w))
             .withColumn("_has_prev", F.lag("_pid").over(w).isNotNull())
             .withColumn("_continues", F.col("_has_prev") & F.col("_first_t").eqNullSafe(F.col("_prev_last_t")))
             .withColumn("_anchor", F.when(~((F.col("_last_seq") == 0) & F.col("_continues")), F.col("_pid")))
             .withColumn("_owner_pid", F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    owners = edges.select(F.col("_pid").alias("_owner_pid"), F.col("_last_seq").alias("_owner_seq"))
    edges = edges.join(owners, "_owner_pid", "left").select(
        "_pid", "_offset", "_continues", "_owner_pid", "_owner_seq")
    # The edge table has one row per partition: broadcasting it is bounded.
    r = runs.join(F.broadcast(edges), "_pid")
    cont = (F.col("_seq") == 0) & F.col("_continues")
    r = r.select(
        F.when(cont, F.col("_owner_pid")).otherwise(F.col("_pid")).alias("_ip"),
        F.when(cont, F.col("_owner_seq")).otherwise(F.col("_seq")).alias("_is"),
        (F.col("_offset") + F.col("_start") + 1).alias("_s"), "_len", "semantic_type")
    out = r.groupBy("_ip", "_is").agg(
        F.min("_s").alias("start_row"), F.sum("_len").alias("n_rows"), F.min_by("semantic_type", "_s").alias("semantic_type"))
    if penalty is not None:
        from .segments import noisy_ranges

        return noisy_ranges(out, penalty, p).select(F.lit(column).alias("column"), "*")
    return out.select(F.lit(column).alias("column"), "start_row",
                      (F.col("start_row") + F.col("n_rows") - 1).alias("end_row"), "n_rows", "semantic_type",
                      F.lit(1.0).alias("confidence"))
