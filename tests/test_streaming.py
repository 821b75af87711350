"""Streaming re-merge: after the change stream is drained the table equals a full merge."""

import os
import tempfile

from pyspark.sql import functions as F

from keymerge import Mapping, MergeSpec, Policy, SourceField, merge
from keymerge.streaming import current_table, remerge_stream


def test_stream_of_changes_keeps_table_current(spark):
    root = tempfile.mkdtemp(prefix="km-stream-")
    cust = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "k long, name string")
    old = spark.createDataFrame([(i % 10, i, 1.0 * i) for i in range(40)], "k long, oid long, amt double")
    new = old.filter(F.col("k") != 4).withColumn("amt", F.when(F.col("k") == 2, F.col("amt") * 3).otherwise(F.col("amt")))
    spec = MergeSpec.build(["k"], [
        Mapping("k", Policy("firstMatch"), (SourceField("c", "k"), SourceField("o", "k"))),
        Mapping("name", Policy("firstMatch"), (SourceField("c", "name"),)),
        Mapping("total", Policy("sum"), (SourceField("o", "amt"),)),
    ])
    base = merge({"c": cust, "o": old}, spec)
    changes_dir = os.path.join(root, "changes")
    diff = old.exceptAll(new).unionByName(new.exceptAll(old))
    diff.write.parquet(changes_dir)
    stream = spark.readStream.schema(diff.schema).parquet(changes_dir)
    out = os.path.join(root, "out")
    q = remerge_stream(stream, "o", lambda: {"c": cust, "o": new}, spec, out, os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = sorted(map(tuple, current_table(spark, base, out, spec).collect()))
    want = sorted(map(tuple, merge({"c": cust, "o": new}, spec).collect()))
    assert got == want
    assert 4 not in [r[0] for r in got]
