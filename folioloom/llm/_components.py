"""Connected components of a graph given as pairs, by alternating stars; joins whose keys may be very unequal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HEAVY = 4096  # at most so many keys are broadcast
FEW = 1000  # rows of one key that are no burden to a task


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups, which hold one row a key and in `size` how many of the `total` rows have it.

    Fewer than HEAVY keys can hold more than a HEAVY-th of all rows each: if there are
    such groups, they are broadcast, so their rows stay where they are; the others
    are joined by key.
    """
    bound = max(FEW, total // HEAVY)
    if groups.where(F.col(size) > bound).isEmpty():
        return rows.join(groups, keys)
    heavy = F.broadcast(groups.where(F.col(size) > bound))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= bound), keys)
    return rows.join(heavy, keys).unionByName(light)


def prepare(df: DataFrame) -> None:
    """Names a checkpoint folder only where the session names none: one in the warehouse, which driver and executors share."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, dense: int = 0) -> DataFrame:
    """edges: a, b (long). Returns node and root, the least node reachable, for every node on an edge between two nodes.

    Large stars hang each node's greater neighbours on its least one, small stars
    the lesser; the pairs stop changing after O(log^2 n) rounds, mostly two or
    three. Minima are combined before the shuffle, and the minima of hubs are
    broadcast to their edges, so a hub's edges are never one task's.

    With `dense`, edges lie in parts of about so many rows (16 parts at least), and
    what a round reads twice is kept meanwhile: fewer tasks where edges are few.
    """
    prepare(edges)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if dense:
        laid = max(16, -(-edges.count() // dense))
        kept = lambda x: x.coalesce(laid)
        held = lambda x: x.coalesce(laid).persist()
    else:
        kept = held = lambda x: x
    edges = kept(edges).checkpoint()
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = held(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = held(join_counted(both, low, ["a"], "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], "n", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = kept(small).checkpoint()
        if dense:
            low.unpersist(), large.unpersist()
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
