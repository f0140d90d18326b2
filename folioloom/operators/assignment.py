"""One-to-one assignment: each asker in order takes its first candidate that nobody before it has taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.sources.shared import ensure_checkpoints


def first_free(candidates: DataFrame, askers: int) -> DataFrame:
    """candidates: ord (from 1 to `askers`), rank (long, what an asker prefers), item. Returns ord and item of those who get one.

    Of an asker's candidates only the first `askers` matter, since the others can take
    one less than that. Then, round by round, every asker proposes to its first item
    left. An item's holder is the first who has proposed to it so far and can only be
    followed by an earlier one, so all later askers strike it off; when nobody strikes
    anything, this has ended where taking turns ends. Each round is a few joins over at
    most `askers` squared rows.
    """
    ensure_checkpoints(candidates.sparkSession)
    first = Window.partitionBy("ord").orderBy("rank", "item")
    left = candidates.distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= askers).checkpoint()
    n, before = left.count(), None
    while n != before:
        ask = left.groupBy("ord").agg(F.min_by("item", "k").alias("item"))
        held = ask.groupBy("item").agg(F.min("ord").alias("holder"))
        left = left.join(held, "item", "left").where("holder IS NULL OR ord <= holder").drop("holder").checkpoint()
        n, before = left.count(), n
    return left.groupBy("ord").agg(F.min_by("item", "k").alias("item"))
