"""A key (or link value) holding a third of all rows must not break or serialise the plan."""

from pyspark.sql import functions as F

from keymerge.plans.explain import plan_text
from keymerge import Mapping, MergeSpec, Policy, SourceField, merge
from keymerge.operators.entities import Link, entity_merge


def test_hot_key_merge(spark):
    n = 300_000
    a = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                              F.col("id").alias("x"))
    b = spark.range(n // 10).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") * 7).alias("k"),
                                    F.lit(1).alias("y"))
    spec = MergeSpec.build(["k"], [
        Mapping("k", Policy("firstMatch"), (SourceField("A", "k"), SourceField("B", "k"))),
        Mapping("sx", Policy("sum"), (SourceField("A", "x"),)),
        Mapping("n", Policy("count_rows"), (SourceField("B", "y"),)),
        Mapping("fx", Policy("firstMatch"), (SourceField("A", "x"),)),
    ])
    out = merge({"A": a, "B": b}, spec, order_by={"A": "x", "B": "y"})
    hot = out.filter("k = 0").first()
    n_a, n_b = n // 3, (n // 10 + 2) // 3
    assert hot["n"] == n_a * n_b
    assert hot["sx"] == sum(range(0, n, 3)) * n_b
    assert hot["fx"] == 0
    plan = plan_text(out)
    assert "partial_sum" in plan  # the hot key shrinks to one row per task before it is shuffled


def test_hot_value_entity_resolution(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("v"), (F.col("id") / 2).cast("long").cast("string"))).alias("key"))
    out = entity_merge({"t": df}, [Link("t", "key", "t", "key")],
                       [Mapping("n", Policy("count_rows"), (SourceField("t", "id"),))], ids={"t": "id"})
    sizes = out.groupBy("n").count().collect()
    total = sum(r["n"] * r["count"] for r in sizes)
    assert total == n
    assert max(r["n"] for r in sizes) >= n // 3
