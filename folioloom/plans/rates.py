"""Rate limits over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.plans.registry import query
from folioloom.sources.tables import table
from folioloom.streaming import rate_limit


@query("Z1_rate_limit")
def rate_limited(spark, d):
    """Accepted and rejected hits of each client, at most 3 in 6 hours. Sequential, so tested against brute force."""
    hits = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return rate_limit.batch(hits, 3, 6 * 3600.0).groupBy("key").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
