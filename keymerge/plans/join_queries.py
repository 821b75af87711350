"""Registered as-of, interval and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.timejoins import asof_join, interval_join, range_join
from .registry import register, table


@register("join_asof", """
SELECT e.event_id, e.user_id, e.ts, c.click_id, c.click_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click') e
ASOF LEFT JOIN (SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click') c
ON e.user_id = c.user_id AND e.ts >= c.click_ts
""")
def join_asof(spark, sf):
    """Every other event with its user's last click at or before it."""
    events = table(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    return asof_join(events.filter("event_type <> 'click'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click_ts", tie_by="click_id")


@register("join_asof_next", """
SELECT e.event_id, e.user_id, e.ts, c.click_id, c.click_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') e
ASOF JOIN (SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click') c
ON e.user_id = c.user_id AND e.ts <= c.click_ts
WHERE c.click_ts - e.ts <= INTERVAL 2 DAY
""")
def join_asof_next(spark, sf):
    """Every view with its user's next click, if that comes within two days; chunks of at most 1,000 rows of a user."""
    events = table(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    return asof_join(events.filter("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click_ts", how="inner",
                     direction="forward", tie_by="click_id", tolerance=2 * 86_400_000_000, rows_per_task=1000)


@register("join_interval", """
SELECT p.event_id, p.user_id, p.ts, s.error_id, s.since, s.until
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'error') p
JOIN (SELECT event_id AS error_id, user_id, ts AS since, ts + CAST(floor(value) AS INTEGER) * INTERVAL 1 HOUR AS until FROM events WHERE event_type = 'error') s
ON p.user_id = s.user_id AND p.ts BETWEEN s.since AND s.until
""")
def join_interval(spark, sf):
    """Events with every spell after an error of their user (as many hours as the error's value) that they fall into."""
    events = table(spark, sf, "events")
    spells = events.filter("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("since"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("value").cast("int"))).alias("until"))
    return interval_join(events.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), spells, "user_id", "ts", "since", "until")


@register("join_range", """
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, s.s_suppkey, s.s_nationkey, s.s_acctbal
FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal BETWEEN s.s_acctbal - 250 AND s.s_acctbal + 250
""")
def join_range(spark, sf):
    """Customers and suppliers of a nation whose balances are at most 250 apart."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return range_join(c, s, [("c_nationkey", "s_nationkey")], "c_acctbal", "s_acctbal", 250.0)
