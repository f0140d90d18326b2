"""Ranks inside keys that may hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1_000_000


def ranked(df: DataFrame, keys: list[str], number: str, name: str, descending: bool = False, width: int = WIDTH, then: list[Column | str] | None = None) -> DataFrame:
    """Ranks from 1 by a whole number (and `then` among equals) inside `keys`.

    The number's range is cut into buckets of `width`: rows are ranked inside their
    bucket and the sizes of the buckets before are added, so no task sees more of a
    key than one bucket.
    """
    bucket = F.floor(F.col(number) / width)
    order = F.desc if descending else F.asc
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy(order("_bucket"))) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order(number), *(then or [])))
    return cut.withColumn(name, within).join(before, [*keys, "_bucket"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_bucket", "_before")
