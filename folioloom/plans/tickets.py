"""Ticket visibility, statistics, transitions, history and notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators.numbering import ranked
from folioloom.plans.registry import query
from folioloom.sources.tables import OFFICES, TICKETS, offices, table, tickets
from folioloom.streaming import ticket_state

TRANSITIONS = [("office", "Open", "In Progress"), ("office", "In Progress", "Resolved"), ("office", "Resolved", "Closed"), ("student", "Resolved", "Closed"), ("student", "Resolved", "Open"), ("student", "Closed", "Open"), ("admin", "Open", "In Progress"), ("admin", "Open", "Closed"), ("admin", "In Progress", "Resolved"), ("admin", "In Progress", "Open"), ("admin", "Resolved", "Closed"), ("admin", "Closed", "Open")]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TRANSITIONS)
TURNS = 4  # tasks a core that multiply tickets by staff
ACTORS = [("student", 7, None), ("student", 301, None), ("office", None, 3), ("office", None, 11), ("admin", None, None)]


def _actors(spark):
    return spark.createDataFrame(ACTORS, "role string, user int, place int")


_ACTORS = "actors AS (SELECT * FROM (VALUES ('student', 7, NULL), ('student', 301, NULL), ('office', NULL, 3), ('office', NULL, 11), ('admin', NULL, NULL)) t(role, usr, place))"


@query("F2_visible_tickets", f"WITH {TICKETS} SELECT ticket_id, status, priority, office, row_number() OVER (ORDER BY updated_at DESC, ticket_id) AS rank FROM tickets WHERE office_id = 3 AND status = 'Open' AND priority IN ('Urgent', 'High')")
def visible_tickets(spark, d):
    """An office's open urgent and high tickets, newest first; numbered day by day."""
    t = tickets(spark, d).where("office_id = 3 AND status = 'Open' AND priority IN ('Urgent', 'High')")
    t = t.select("ticket_id", "status", "priority", "office", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"))
    return ranked(t, ["office"], "at", "rank", descending=True, width=86_400_000_000, then=["ticket_id"]).drop("at")


@query("F3_policy", f"WITH {TICKETS}, {_ACTORS} SELECT role, usr, place, count(*) AS visible, sum(CASE WHEN role <> 'student' AND status <> 'Closed' THEN 1 ELSE 0 END)::BIGINT AS updatable FROM tickets JOIN actors ON role = 'admin' OR (role = 'student' AND user_id = usr) OR (role = 'office' AND office_id = place) GROUP BY role, usr, place")
def policy(spark, d):
    a = _actors(spark)
    sees = (F.col("role") == "admin") | ((F.col("role") == "student") & (F.col("user_id") == F.col("user"))) | ((F.col("role") == "office") & (F.col("office_id") == F.col("place")))
    changes = (F.col("role") != "student") & (F.col("status") != "Closed")
    return tickets(spark, d).join(F.broadcast(a), sees).groupBy("role", F.col("user").alias("usr"), "place").agg(F.count("*").alias("visible"), F.count_if(changes).alias("updatable"))


@query("F4_transitions", f"WITH {TICKETS}, allowed AS (SELECT * FROM (VALUES {_VALUES}) t(role, status, next)) SELECT role, status, next, count(*) AS tickets FROM tickets JOIN allowed USING (status) GROUP BY role, status, next")
def transitions(spark, d):
    """How many tickets each role may move where."""
    allowed = spark.createDataFrame(TRANSITIONS, "role string, status string, next string")
    counts = tickets(spark, d).groupBy("status").agg(F.count("*").alias("tickets"))
    return counts.join(F.broadcast(allowed), "status").select("role", "status", "next", "tickets")


@query("F20_client_filter", f"WITH {TICKETS} SELECT ticket_id, user_name, office FROM tickets WHERE contains(lower(concat_ws(' ', ticket_id::VARCHAR, user_name, office)), '00012') AND status = 'Open'")
def client_filter(spark, d):
    blob = F.lower(F.concat_ws(" ", F.col("ticket_id").cast("string"), "user_name", "office"))
    return tickets(spark, d).where(F.contains(blob, F.lit("00012")) & (F.col("status") == "Open")).select("ticket_id", "user_name", "office")


@query("A1_ticket_statistics", f"WITH {TICKETS} SELECT coalesce(office, 'Unassigned') AS office, count(*) AS total, count_if(status = 'Open') AS open, count_if(status = 'In Progress') AS in_progress, count_if(status = 'Resolved') AS resolved, count_if(status = 'Closed') AS closed FROM tickets GROUP BY ROLLUP (office) HAVING office IS NOT NULL OR grouping(office) = 1".replace("SELECT coalesce(office, 'Unassigned') AS office", "SELECT CASE WHEN grouping(office) = 1 THEN 'all' ELSE coalesce(office, 'Unassigned') END AS office").replace(" HAVING office IS NOT NULL OR grouping(office) = 1", ""))
def ticket_statistics(spark, d):
    of = lambda s: F.count_if(F.col("status") == s)
    out = tickets(spark, d).rollup("office").agg(F.grouping("office").alias("g"), F.count("*").alias("total"), of("Open").alias("open"), of("In Progress").alias("in_progress"), of("Resolved").alias("resolved"), of("Closed").alias("closed"))
    return out.withColumn("office", F.when(F.col("g") == 1, "all").otherwise(F.coalesce("office", F.lit("Unassigned")))).drop("g")


@query("A15_unread", "SELECT user_id, count(*) AS notifications, count_if(event_type <> 'view') AS unread FROM events GROUP BY user_id")
def unread(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("notifications"), F.count_if(F.col("event_type") != "view").alias("unread"))


@query("A16_office_dashboard", f"WITH {TICKETS}, r AS (SELECT l_orderkey ticket_id, count(*) n FROM lineitem GROUP BY l_orderkey) SELECT office, count_if(status = 'Open') AS open, count_if(status = 'In Progress') AS in_progress, count_if(status = 'Closed') AS closed, count_if(priority IN ('High', 'Urgent')) AS pressing, coalesce(sum(n), 0)::BIGINT AS replies FROM tickets LEFT JOIN r USING (ticket_id) GROUP BY office")
def office_dashboard(spark, d):
    replies = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id")).agg(F.count("*").alias("n"))
    of = lambda s: F.count_if(F.col("status") == s)
    return tickets(spark, d).join(replies, "ticket_id", "left").groupBy("office").agg(of("Open").alias("open"), of("In Progress").alias("in_progress"), of("Closed").alias("closed"), F.count_if(F.col("priority").isin("High", "Urgent")).alias("pressing"), F.coalesce(F.sum("n"), F.lit(0)).alias("replies"))


@query("A17_users_by_role", "SELECT CASE WHEN c_acctbal < 0 THEN 'office' WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'student' END AS role, count(*) AS users FROM customer GROUP BY 1")
def users_by_role(spark, d):
    role = F.when(F.col("c_acctbal") < 0, "office").when(F.col("c_custkey") % 100 == 0, "admin").otherwise("student")
    return table(spark, d, "customer").groupBy(role.alias("role")).agg(F.count("*").alias("users"))


@query("A18_ticket_cards", f"WITH {TICKETS} SELECT user_id, count(*) AS total, count_if(status IN ('Open', 'In Progress')) AS active, count_if(status IN ('Resolved', 'Closed')) AS finished FROM tickets GROUP BY user_id")
def ticket_cards(spark, d):
    return tickets(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("Open", "In Progress")).alias("active"), F.count_if(F.col("status").isin("Resolved", "Closed")).alias("finished"))


@query("J3_ticket_view", f"WITH {TICKETS}, {OFFICES} SELECT ticket_id, any_value(user_name) AS user_name, any_value(o.service_category) AS service_category, count(l_orderkey) AS replies, coalesce(string_agg(l_linenumber::VARCHAR || l_returnflag, ',' ORDER BY l_shipdate, l_linenumber, l_returnflag), '') AS thread FROM tickets t LEFT JOIN offices o USING (office_id) LEFT JOIN lineitem l ON l.l_orderkey = t.ticket_id GROUP BY ticket_id")
def ticket_view(spark, d):
    item = F.struct("l_shipdate", "l_linenumber", "l_returnflag")
    replies = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id")).agg(F.sort_array(F.collect_list(item)).alias("r"))
    o = offices(spark, d).select("office_id", "service_category")
    thread = F.array_join(F.transform("r", lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return tickets(spark, d).join(o, "office_id", "left").join(replies, "ticket_id", "left").select("ticket_id", "user_name", "service_category", F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("replies"), F.coalesce(thread, F.lit("")).alias("thread"))


@query("J8_notify_staff", f"WITH {TICKETS} SELECT t.ticket_id, s_suppkey AS user_id, 'Ticket ' || t.ticket_id || ' is ' || t.status AS body FROM tickets t JOIN supplier ON s_nationkey = t.office_id WHERE t.priority = 'Urgent' AND s_suppkey <> t.user_id")
def notify_staff(spark, d):
    """One row for each urgent ticket and member of its office's staff, which is the product that the result is; a text is made once a ticket, and tickets are dealt out evenly first, since a file's few parts would each multiply theirs."""
    text = F.concat(F.lit("Ticket "), F.col("ticket_id").cast("string"), F.lit(" is "), "status")
    t = tickets(spark, d).where("priority = 'Urgent'").select("ticket_id", "office_id", F.col("user_id").alias("asker"), text.alias("body"))
    t = t.repartition(TURNS * spark.sparkContext.defaultParallelism, "ticket_id")
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("user_id"))
    return t.join(s, (s.s_nationkey == t.office_id) & (s.user_id != t.asker)).select("ticket_id", "user_id", "body")


@query("T8_notifications", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id LIMIT 100")
def notifications(spark, d):
    """The newest hundred unread; the limit is the feature."""
    return table(spark, d, "events").where("event_type <> 'view'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "event_type")


@query("T9_users", "SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS rank, c_mktsegment AS role FROM customer")
def users(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("role"))
    return ranked(c, ["role"], "c_custkey", "rank", descending=True)


@query("W18_needs_attention", f"WITH {TICKETS} SELECT office, ticket_id, rank FROM (SELECT office, ticket_id, row_number() OVER (PARTITION BY office ORDER BY CASE priority WHEN 'Urgent' THEN 0 WHEN 'High' THEN 1 ELSE CASE WHEN status = 'Open' THEN 2 ELSE 3 END END, updated_at DESC, ticket_id) AS rank FROM tickets WHERE status IN ('Open', 'In Progress')) WHERE rank <= 4")
def needs_attention(spark, d):
    level = F.when(F.col("priority") == "Urgent", 0).when(F.col("priority") == "High", 1).when(F.col("status") == "Open", 2).otherwise(3)
    w = Window.partitionBy("office").orderBy(level, F.desc("updated_at"), "ticket_id")
    t = tickets(spark, d).where(F.col("status").isin("Open", "In Progress"))
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 4").select("office", "ticket_id", "rank")


@query("W19_history", "SELECT l_orderkey AS ticket_id, l_linenumber, l_returnflag AS value, lag(l_returnflag) OVER w AS before, date_diff('day', lag(l_shipdate) OVER w, l_shipdate) AS days FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey)")
def history(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticket_id"), "l_linenumber", F.col("l_returnflag").alias("value"), F.lag("l_returnflag").over(w).alias("before"), F.datediff("l_shipdate", F.lag("l_shipdate").over(w)).cast("long").alias("days"))


@query("U1_created", f"WITH {TICKETS} SELECT ticket_id, 'TK-' || strftime(updated_at, '%Y%m%d') || '-' || upper(substring(sha1(ticket_id::VARCHAR), 1, 6)) AS code, 'created' AS action, user_id AS actor FROM tickets WHERE status = 'Open'")
def created(spark, d):
    """Audit rows for new tickets; codes follow from the key, so a rerun gives the same."""
    code = F.concat(F.lit("TK-"), F.date_format("updated_at", "yyyyMMdd"), F.lit("-"), F.upper(F.substring(F.sha1(F.col("ticket_id").cast("string")), 1, 6)))
    return tickets(spark, d).where("status = 'Open'").select("ticket_id", code.alias("code"), F.lit("created").alias("action"), F.col("user_id").alias("actor"))


#: Events as updates of their user's ticket: what each asks for, and in which role.
WANTED = {"click": "In Progress", "purchase": "Resolved", "error": "Closed", "signup": "Open"}
PRIORITIES = [(200, "Urgent"), (150, "High")]
_UPDATES = (
    "updates AS (SELECT user_id ticket_id, event_id seq, ts, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in WANTED.items()) + " END wanted, CASE " + " ".join(f"WHEN value >= {a} THEN '{b}'" for a, b in PRIORITIES) + " END priority,"
    " CASE WHEN k >= 70 THEN 'admin' WHEN k >= 20 THEN 'office' ELSE 'student' END AS role FROM (SELECT *, try_cast(regexp_extract(props, '[0-9]+') AS INT) k FROM events)), numbered AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY ts, seq) n FROM updates WHERE ticket_id IS NOT NULL)"
)
_MAY = "(u.wanted IS NULL OR u.wanted = s.status OR u.role = 'admin' OR (u.role = 'student' AND s.status = 'Resolved' AND u.wanted = 'Closed') OR (u.role = 'office' AND (" + " OR ".join(f"s.status = '{a}' AND u.wanted = '{b}'" for a, to in ticket_state.MOVES.items() for b in to) + "))) AND (u.priority IS NULL OR u.role IN ('admin', 'office'))"
_WALK = f"""{_UPDATES}, steps AS (SELECT ticket_id, 0::BIGINT n, NULL::BIGINT seq, NULL::TIMESTAMP ts, false ok, NULL::VARCHAR old_status, NULL::VARCHAR old_priority, 'Open' status, 'Medium' priority, NULL::TIMESTAMP resolved_at, NULL::TIMESTAMP closed_at FROM (SELECT DISTINCT ticket_id FROM numbered)
 UNION ALL SELECT ticket_id, n, seq, ts, ok, status, priority, CASE WHEN ok THEN after ELSE status END, CASE WHEN ok THEN coalesce(asked, priority) ELSE priority END,
  CASE WHEN ok AND after = 'In Progress' AND status IN ('Resolved', 'Closed') THEN NULL WHEN ok AND after = 'Resolved' THEN coalesce(resolved_at, ts) ELSE resolved_at END,
  CASE WHEN ok AND after = 'In Progress' AND status = 'Closed' THEN NULL WHEN ok AND after = 'Closed' THEN coalesce(closed_at, ts) ELSE closed_at END
  FROM (SELECT s.ticket_id, u.n, u.seq, u.ts, {_MAY} ok, s.status, s.priority, u.priority asked, coalesce(u.wanted, s.status) after, s.resolved_at, s.closed_at FROM steps s JOIN numbered u ON u.ticket_id = s.ticket_id AND u.n = s.n + 1))"""


def updates(spark, d):
    e = table(spark, d, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    names = F.create_map(*(F.lit(x) for p in WANTED.items() for x in p))
    priority = reduce(lambda w, p: w.when(F.col("value") >= p[0], p[1]), PRIORITIES[1:], F.when(F.col("value") >= PRIORITIES[0][0], PRIORITIES[0][1]))
    return e.select(F.col("user_id").alias("ticket_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(names, "event_type").alias("wanted"), priority.alias("priority"), F.when(k >= 70, "admin").when(k >= 20, "office").otherwise("student").alias("role"))


@query("U2_latest_state", f"WITH RECURSIVE {_WALK} SELECT ticket_id, arg_max(status, n) AS status, arg_max(priority, n) AS priority, max(resolved_at) FILTER (WHERE n = m) AS resolved_at, max(closed_at) FILTER (WHERE n = m) AS closed_at, count_if(ok) AS accepted, count_if(NOT ok AND n > 0) AS refused FROM (SELECT *, max(n) OVER (PARTITION BY ticket_id) m FROM steps) GROUP BY ticket_id")
def latest_state(spark, d):
    """Each ticket's state after its last update; reopening clears when it was resolved."""
    out = ticket_state.latest(ticket_state.batch(updates(spark, d)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("resolved_at", "closed_at")})


@query("U2_field_changes", f"WITH RECURSIVE {_WALK} SELECT ticket_id, seq, ts, 'status' AS field_name, old_status AS old_value, status AS new_value FROM steps WHERE ok AND old_status <> status UNION ALL SELECT ticket_id, seq, ts, 'priority', old_priority, priority FROM steps WHERE ok AND old_priority <> priority")
def field_changes(spark, d):
    """The audit of accepted updates, one row a changed field."""
    return ticket_state.audit(ticket_state.batch(updates(spark, d))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("U3_replies_reopen", f"WITH {TICKETS}, r AS (SELECT l_orderkey ticket_id, count(*) n, max(l_returnflag = 'R') student FROM lineitem GROUP BY 1) SELECT ticket_id, n AS replies, CASE WHEN student AND status IN ('Resolved', 'Closed') THEN 'Open' ELSE status END AS status FROM tickets JOIN r USING (ticket_id) WHERE status <> 'Closed' OR student")
def replies_reopen(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id")).agg(F.count("*").alias("replies"), F.max(F.col("l_returnflag") == "R").alias("student"))
    t = tickets(spark, d).join(r, "ticket_id").where("status <> 'Closed' OR student")
    return t.select("ticket_id", "replies", F.when(F.col("student") & F.col("status").isin("Resolved", "Closed"), "Open").otherwise(F.col("status")).alias("status"))


@query("U6_mark_read", "SELECT user_id, count_if(event_type <> 'view' AND ts < TIMESTAMP '2024-01-15') AS marked, count_if(event_type <> 'view' AND ts >= TIMESTAMP '2024-01-15') AS left_unread FROM events GROUP BY user_id")
def mark_read(spark, d):
    new = (F.col("event_type") != "view") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    old = (F.col("event_type") != "view") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(old).alias("marked"), F.count_if(new).alias("left_unread"))


@query("U7_audit", f"WITH {TICKETS} SELECT ticket_id, 'status' AS field_name, 'Open' AS old_value, status AS new_value, substring('Status changed from Open to ' || status || ' by ' || user_name, 1, 40) AS note FROM tickets WHERE status <> 'Open'")
def audit(spark, d):
    note = F.substring(F.concat(F.lit("Status changed from Open to "), "status", F.lit(" by "), "user_name"), 1, 40)
    return tickets(spark, d).where("status <> 'Open'").select("ticket_id", F.lit("status").alias("field_name"), F.lit("Open").alias("old_value"), F.col("status").alias("new_value"), note.alias("note"))


@query("H10_offices", f"WITH {OFFICES} SELECT office_id, office, service_category FROM offices")
def list_offices(spark, d):
    return offices(spark, d)


@query("H21_health", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def health(spark, d):
    parts = [table(spark, d, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in ("documents", "orders", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


URGENT, HIGH, MEDIUM = ["entionre", "wher", "ought"], ["thered", "anden", "ingre"], ["the", "que", "der"]


def _hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{t}')::INT" for t in terms) + ")"


@query("C22_priority", rf"WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) k, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) p FROM documents) SELECT doc_id, CASE WHEN {_hits('k', URGENT)} >= 1 THEN 'Urgent' WHEN {_hits('k', HIGH)} + {_hits('p', HIGH)} >= 2 THEN 'High' WHEN {_hits('k', MEDIUM)} >= 1 THEN 'Medium' ELSE 'Low' END AS priority FROM t")
def priority(spark, d):
    k, p = tf.normal("text"), tf.title_key("text")
    level = F.when(tf.hits(k, URGENT) >= 1, "Urgent").when(tf.hits(k, HIGH) + tf.hits(p, HIGH) >= 2, "High").when(tf.hits(k, MEDIUM) >= 1, "Medium").otherwise("Low")
    return table(spark, d, "documents").select("doc_id", level.alias("priority"))
