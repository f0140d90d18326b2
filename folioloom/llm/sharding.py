"""Sharding by balanced label propagation, with DataFrame functions only.

Documents are linked if their texts are equal. They are first dealt evenly by a
hash; then, round by round, linked documents move to the shard that holds most of
their group. Moves are admitted under quotas for each pair of shards: a shard takes
in as many as it sends out, and beyond that as many as it has unlinked documents to
give away, which fill the places left elsewhere, so the row counts of any two shards
never differ by more than one. A group larger than a shard is gathered in as few
shards as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _components as cc
from ._repeats import parts

SHARDS = 40
ROUNDS = 4


def numbered(df: DataFrame, keys: list[str], salt: Column, order: list, name: str) -> DataFrame:
    """Gapless numbers from 0 within `keys`, counted by salt so that a large key is not one task's."""
    df = df.withColumn("_salt", salt)
    within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    counts = df.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_salt", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt")) - F.col("_n")).alias("_before"))
    return df.withColumn(name, within).join(before, [*keys, "_salt"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_salt", "_before")


def _salts(df: DataFrame) -> int:
    """Into how many parts a key that may hold all rows is split; each of them is one task's."""
    return 8 * parts(df)


def _spread(column: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts))


def _cumulated(df: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Half-open ranges of a running sum over shards (one row a shard)."""
    up_to = F.sum(value).over(Window.partitionBy(F.lit(0)).orderBy("shard"))
    return df.withColumn(high, up_to).withColumn(low, up_to - F.col(value))


def quotas(wish: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the wished moves (from, to) go ahead, so that no shard gains more than it has free.

    Moves are given up along shortest ways from a shard that may gain to one that gains too much.
    """
    flow = {e: n for e, n in wish.items() if n and e[0] != e[1]}
    spare = {s: free.get(s, 0) for e in flow for s in e}
    for (a, b), n in flow.items():
        spare[a] += n
        spare[b] -= n
    for over in sorted(s for s in spare if spare[s] < 0):
        while spare[over] < 0:
            after, queue = {over: over}, [over]
            for at in queue:
                if spare[at] > 0:
                    break
                for a in sorted((a for a, b in flow if b == at and a not in after), key=lambda x: -spare[x]):
                    after[a] = at
                    queue.append(a)
            way = []
            start = at
            while at != over:
                way.append((at, after[at]))
                at = after[at]
            n = min(-spare[over], spare[start], *(flow[e] for e in way))
            for e in way:
                flow[e] -= n
                if not flow[e]:
                    del flow[e]
            spare[over] += n
            spare[start] -= n
    return flow


def propagate(rows: DataFrame, shards: int, total: int, turn: int = 0) -> DataFrame:
    """Round `turn`. rows: rid, g1, g2 (group), members, shard. Where several shards hold most of a group, each round draws anew."""
    room = max(1, total // shards)
    linked = rows.where("members > 1")
    held = linked.groupBy("g1", "g2", "members", "shard").agg(F.count("*").alias("n"))
    best = Window.partitionBy("g1", "g2").orderBy(F.desc("n"), F.xxhash64("g1", "shard", F.lit(turn)), "shard")
    wanted = held.withColumn("place", F.row_number().over(best) - 1).withColumn("needed", F.least(F.lit(shards), F.ceil(F.col("members") / room))).where("place < needed").select("g1", "g2", "place", F.col("shard").alias("to"))
    # who stands in none of the group's chosen shards moves to one of them
    home = held.join(wanted.select("g1", "g2", F.col("to").alias("shard")), ["g1", "g2", "shard"], "left_anti").select("g1", "g2", "shard", "n")
    chosen = wanted.groupBy("g1", "g2").agg(F.sort_array(F.collect_list(F.struct("place", "to"))).alias("tos"))
    asked = home.join(chosen, ["g1", "g2"])
    movers = cc.join_counted(linked, asked, ["g1", "g2", "shard"], "n", total)
    movers = movers.select("rid", "shard", "members", "g1", F.col("tos")[F.pmod(F.xxhash64("rid"), F.size("tos")).cast("int")]["to"].alias("to"))
    salt = F.when(F.col("members") > 1000, _spread("rid", _salts(rows))).otherwise(F.pmod(F.col("g1"), F.lit(_salts(rows))))
    movers = numbered(movers, ["shard", "to"], salt, ["g1", "rid"], "turn").checkpoint()
    wish = {(r["shard"], r["to"]): r["count"] for r in movers.groupBy("shard", "to").count().collect()}
    free = {r["shard"]: r["count"] for r in rows.where("members = 1").groupBy("shard").count().collect()}
    quota = rows.sparkSession.createDataFrame([(*e, n) for e, n in quotas(wish, free).items()], "shard int, to int, quota long")
    admitted = movers.join(F.broadcast(quota), ["shard", "to"]).where("turn < quota").select("rid", "shard", "to").checkpoint()

    flow = admitted.select(F.col("to").alias("shard"), F.lit(1).alias("x")).unionByName(admitted.select("shard", F.lit(-1).alias("x"))).groupBy("shard").agg(F.sum("x").alias("net"))
    gone = _cumulated(flow.where("net > 0"), "net", "low", "high").select("shard", "net", "low")
    lack = _cumulated(flow.where("net < 0").select("shard", (-F.col("net")).alias("lack")), "lack", "low", "high").select(F.col("shard").alias("fill"), F.col("low").alias("from"), "high")
    spare = numbered(rows.where("members = 1").join(F.broadcast(gone), "shard"), ["shard"], _spread("rid", _salts(rows)), ["rid"], "turn").where("turn < net")
    filled = spare.withColumn("at", F.col("low") + F.col("turn")).join(F.broadcast(lack), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("high"))).select("rid", F.col("fill").alias("to"))
    moves = admitted.select("rid", "to").unionByName(filled)
    return rows.join(moves, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to").checkpoint()


def label_propagation_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows"), shard, slot and grown_shard (null) of every row.

    Row counts of shards differ by at most one. Null texts count as empty; texts that
    are empty are equal, so they are linked; null ids stay null; repeated rows are
    rows of their own; an empty table gives no row. Other columns are ignored. Tables
    that are broadcast or collected have at most one row a pair of shards.
    """
    cc.prepare(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    total = rows.count()
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("members"))
    rows = cc.join_counted(rows, groups, ["g1", "g2"], "members", total)
    rows = numbered(rows.withColumn("all", F.lit(0)), ["all"], _spread("rid", _salts(rows)), ["rid"], "turn")
    rows = rows.withColumn("shard", (F.col("turn") % shards).cast("int")).drop("all", "turn").checkpoint()
    outside = None
    for turn in range(rounds):
        rows = propagate(rows, shards, total, turn)
        # linked documents outside their group's largest shard
        held = rows.where("members > 1").groupBy("g1", "g2", "shard").agg(F.count("*").alias("n")).groupBy("g1", "g2").agg((F.sum("n") - F.max("n")).alias("n"))
        now = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not now or now == outside:
            break
        outside = now
    rows = numbered(rows, ["shard"], _spread("rid", _salts(rows)), ["doc_id", "rid"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return label_propagation_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
