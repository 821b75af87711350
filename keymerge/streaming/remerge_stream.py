"""Keep a merged table current from a stream of source changes (I1 over Structured Streaming).

Each micro-batch holds change rows of one source (old and/or new images).  In
``foreachBatch`` the distinct keys of the batch are re-merged from the current
sources (``incremental.remerge_changed`` semantics: a keyed merge is
independent per key) and written under ``<out>/updates/_epoch=<batch id>``.
The write overwrites that batch's folder, so a batch replayed after a failure
is idempotent.  Keys that no longer produce a row get a tombstone.
``current_table`` folds base + updates into the latest row per key with one
keyed aggregation.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping as TMapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import changed_keys, limit_to_keys
from ..operators.merge import merge
from ..session import materialize
from ..spec import MergeSpec, SpecError

DELETED = "_deleted"
EPOCH = "_epoch"


def upsert_batch(batch: DataFrame, epoch_id: int, source_id: str, sources: TMapping[str, DataFrame],
                 spec: MergeSpec, out_path: str, **merge_kw) -> None:
    """Re-merge the keys touched by ``batch`` and write them (with tombstones) for ``epoch_id``."""
    keys = materialize(changed_keys(spec, source_id, changes=batch), "changed")
    fresh = merge(limit_to_keys(sources, spec, keys, merge_kw.get("order_by")), spec, **merge_kw).withColumn("_present", F.lit(True))
    mine = keys.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(spec.keys)])
    same = reduce(lambda a, b: a & b, [F.col(f"_key_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(spec.keys)])
    rows = mine.join(fresh, same, "left").withColumn(DELETED, F.col("_present").isNull())
    rows = rows.select(*[F.col(f"_key_{i}").alias(k) for i, k in enumerate(spec.keys)],
                       *[c for c in fresh.columns if c not in (*spec.keys, "_present")], DELETED)
    rows.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/updates/{EPOCH}={epoch_id}")


def remerge_stream(changes: DataFrame, source_id: str, current_sources: Callable[[], TMapping[str, DataFrame]],
                   spec: MergeSpec, out_path: str, checkpoint_location: str, trigger: dict | None = None,
                   **merge_kw) -> StreamingQuery:
    """Start the streaming re-merge.  ``current_sources()`` returns the sources as of now."""
    if spec.logic == "or":
        raise SpecError("streaming re-merge needs per-key independence; OR-key merges link across keys")
    if not changes.isStreaming:
        raise SpecError("changes must be a streaming DataFrame (spark.readStream...)")

    def run(batch: DataFrame, epoch_id: int) -> None:
        upsert_batch(batch, epoch_id, source_id, current_sources(), spec, out_path, **merge_kw)

    w = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _batches(spark: SparkSession, folder: str) -> int:
    """Completed batches under ``folder``, in whatever file system it is."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{EPOCH}=*/_SUCCESS")
    return len(done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or [])


def current_table(spark: SparkSession, base: DataFrame, out_path: str, spec: MergeSpec) -> DataFrame:
    """The merged table as of the last completed batch: latest row per key, tombstones removed."""
    keys = list(spec.keys)
    folder = f"{out_path.rstrip('/')}/updates"
    if not _batches(spark, folder):
        return base
    upd = spark.read.parquet(folder)
    cols = [c for c in base.columns if c not in keys]
    latest = upd.groupBy(*keys).agg(F.max_by(F.struct(*cols, DELETED), EPOCH).alias("_r"))
    latest = latest.select(*keys, "_r.*")
    mine = latest.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    kept = base.join(mine, same, "left_anti")
    return kept.unionByName(latest.filter(~F.col(DELETED)).select(*base.columns))
