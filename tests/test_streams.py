"""Streams against plain loops and against their batch forms over the events table."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.plans.tickets import updates
from folioloom.streaming import rate_limit, ticket_state, upserts

SF = "/root/testdata/sf0.001"


def run(spark, make, rows, folder, name, pieces=3):
    """Feeds `rows` in time order as `pieces` micro-batches; gives what the stream appended and the query's last progress."""
    places = rows.withColumn("_p", F.ntile(pieces).over(Window.orderBy("ts", "seq"))).cache()
    for p in range(1, pieces + 1):
        places.where(F.col("_p") == p).drop("_p").coalesce(1).write.parquet(f"{folder}/in/p={p}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ck").start()
    q.processAllAvailable()
    progress = [p for p in q.recentProgress if p.stateOperators]
    q.stop()
    return spark.table(name), progress


def test_tickets_by_a_loop(spark):
    rnd = random.Random(5)
    status, roles = ["Open", "In Progress", "Resolved", "Closed", None], ["admin", "office", "student", "guest", None]
    rows = [(rnd.randrange(4), i, 1000 + i // 2, rnd.choice(status), rnd.choice([None, None, "High", "Low"]), rnd.choice(roles)) for i in range(600)] + [(None, 999, 5, "Closed", None, "admin")]
    df = spark.createDataFrame(rows, "ticket_id long, seq long, s long, wanted string, priority string, role string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want, state = {}, {}
    for ticket, seq, s, wanted, priority, role in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1])):
        now = state.setdefault(ticket, {"status": "Open", "priority": "Medium", "resolved": None, "closed": None})
        open_moves = {("Open", "In Progress"), ("In Progress", "Resolved"), ("In Progress", "Closed"), ("Resolved", "Closed"), ("Resolved", "In Progress")}
        move = (now["status"], wanted)
        fine = wanted in (None, now["status"]) or role == "admin" or (role == "office" and move in open_moves) or (role == "student" and move == ("Resolved", "Closed"))
        fine = fine and (priority is None or role in ("admin", "office"))
        if fine:
            target = wanted or now["status"]
            if target == "Resolved" and now["resolved"] is None:
                now["resolved"] = s
            if target == "Closed" and now["closed"] is None:
                now["closed"] = s
            if target == "In Progress" and now["status"] == "Closed":
                now["closed"] = now["resolved"] = None
            if target == "In Progress" and now["status"] == "Resolved":
                now["resolved"] = None
            now["status"], now["priority"] = target, priority or now["priority"]
        want[seq] = (ticket, fine, now["status"], now["priority"], now["resolved"], now["closed"])
    got = ticket_state.batch(df).withColumns({c: F.unix_timestamp(c) for c in ("resolved_at", "closed_at")}).collect()
    assert {r.seq: (r.ticket_id, r.accepted, r.status, r.priority, r.resolved_at, r.closed_at) for r in got} == want
    assert len({w[1:3] for w in want.values()}) == 8


def test_no_updates(spark):
    none = spark.createDataFrame([], "ticket_id long, seq long, ts timestamp, wanted string, priority string, role string")
    steps = ticket_state.batch(none)
    assert steps.count() == 0 and ticket_state.latest(steps).count() == 0 and ticket_state.audit(steps).count() == 0


def test_ticket_stream_is_the_batch(rocks, tmp_path):
    rows = updates(rocks, SF).select("ticket_id", "seq", "ts", "wanted", "priority", "role")
    got, _ = run(rocks, ticket_state.stream, rows, tmp_path, "walked")
    key = lambda df: sorted(map(tuple, df.select("seq", "ticket_id", "accepted", "status", "priority", "resolved_at", "closed_at", "old_status", "old_priority").collect()), key=lambda r: r[0])
    assert key(got) == key(ticket_state.batch(rows)) and got.count() == rows.count()


def test_limit_stream_is_the_batch_and_forgets_idle_keys(rocks, tmp_path):
    hits = rocks.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    got, progress = run(rocks, lambda s: rate_limit.stream(s, 3, 6 * 3600.0), hits, tmp_path, "limited_events", 5)
    batch = rate_limit.batch(hits.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3, 6 * 3600.0)
    assert sorted((r.seq, r.accepted) for r in got.collect()) == sorted((r.seq, r.accepted) for r in batch.collect())
    assert progress[-1].stateOperators[0].numRowsTotal < 2 * hits.select("key").distinct().count()


def test_upserts_survive_a_replay(spark, tmp_path):
    path, version = f"{tmp_path}/table", F.struct("ts", "seq")
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_type"), "ts", F.col("event_id").alias("seq"))
    assert upserts.latest(spark, path, "k", version) is None
    for p in range(3):
        e.where(F.col("seq") % 3 == p).write.parquet(f"{tmp_path}/in/p={p}")
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = upserts.start(source, path, "k", version, f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, e.groupBy("k").agg(F.max_by("event_type", version), F.max("ts"), F.max_by("seq", version)).collect()))
    rows = lambda: sorted(map(tuple, upserts.latest(spark, path, "k", version).select("k", "event_type", "ts", "seq").collect()))
    assert rows() == want
    upserts.write_batch(e.where("seq % 3 = 1"), 1, path, "k", version)  # an old batch again
    assert rows() == want
    upserts.compact(spark, path, "k", version)
    upserts.compact(spark, path, "k", version)
    assert rows() == want
    upserts.write_batch(e.limit(1).withColumns({"event_type": F.lit("late"), "ts": F.lit("2999-01-01").cast("timestamp_ntz")}), 1_000_000, path, "k", version)
    (tmp_path / "table" / "log" / "batch=000001000001").mkdir()  # a batch that was never finished
    assert [r for r in rows() if r not in want] != [] and len(rows()) == len(want)
