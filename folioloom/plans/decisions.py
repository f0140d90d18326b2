"""What becomes of units: flags, audience, ordered decisions, gates and final buckets, each a table that the SQL walks too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.operators.rules import decided, decided_sql, flag, flag_sql, named, named_sql
from folioloom.plans.quality import _CANDIDATES, _STATUS, UNITS, candidates, units
from folioloom.plans.registry import query
from folioloom.sources.shared import written

#: Flags of a unit that decisions read; conditions on title, content, words, path, parent, topic and toc.
FLAGS = [
    ("generic_title", "title = '' OR NOT contains(title, ' ')"), ("generic_topic", "topic IN ('src0', 'src1', 'src2')"), ("truncated", "words < 5"), ("invalid", "toc AND words < 40"),
    ("hard_negative", "matches(title, '(?i)(licen[sc]e|copyright|password)')"), ("long_title", "length(title) >= 50 AND NOT contains(title, '.')"), ("action_fragment", "matches(title, '^[a-z]')"),
    ("person", "matches(title, '^[A-Z][a-z]+ [A-Z][a-z]+[.]?$')"), ("incomplete", "matches(title, '(?i)(,| of| the| de| und| y| et)$')"), ("weak_title", "length(title) BETWEEN 1 AND 12"),
    ("artifact", "matches(title, '[|#]')"), ("field_label", "matches(content, '(?i)^[a-z ]{3,20}:')"), ("service", "contains(content, '|') OR matches(content, '(?m)^[0-9]+[.)]')"),
    ("reference", "matches(content, '(?i)(see also|refer to|all rights reserved)')"), ("noise", "matches(content, '[#$%&*]{3}')"), ("placeholder", "matches(content, '_{3,}|[.]{4,}')"),
    ("mixed", "matches(content, '(?i)the ') AND matches(content, '(?i) (der|die|und) ') OR matches(content, '(?i) que ') AND matches(content, '(?i) the ')"), ("missing_office", "path IS NULL"), ("missing_who", "NOT matches(content, '(?i) (he|she|they|who|er|sie|il|elle|el|ella) ')"),
    ("no_steps", "NOT contains(content, '.')"), ("few_steps", "words < 60"), ("no_time", "NOT matches(content, '[0-9]')"), ("blank_list", "matches(content, '(?m)^\\s*$')"), ("sectioned", "matches(content, '(?m)^[A-Z].*[.]$')"),
]
_FLAGGED = "flagged AS (SELECT *, " + ", ".join(f"{flag_sql(c)} {n}" for n, c in FLAGS) + " FROM bucketed)"
_BASE = f"{UNITS}, {_STATUS}, {_CANDIDATES}, {_FLAGGED}"


def flagged(spark, d):
    return candidates(spark, d).withColumns({n: flag(c) for n, c in FLAGS})


#: Who a unit speaks to: words that show it, and what each is worth.
STUDENT = [("the ", 1), (" que ", 1), (" you ", 2), (" der ", 1), ("?", 2)]
INTERNAL = [("###", 2), ("$$$", 2), ("%%%", 2), ("|", 1), ("license", 3)]


@query("C30_audience", f"WITH {UNITS}, s AS (SELECT doc_id, " + " + ".join(f"{w} * contains(lower(content), '{t}')::INT" for t, w in STUDENT) + " student, " + " + ".join(f"{w} * contains(lower(content), '{t}')::INT" for t, w in INTERNAL) + " internal FROM units) SELECT doc_id, student::BIGINT AS student, internal::BIGINT AS internal, CASE WHEN student = 0 AND internal = 0 THEN 'ambiguous' WHEN internal >= 4 AND student < 2 THEN 'internal_heavy' WHEN student > internal THEN 'student' WHEN internal > student THEN 'internal' ELSE 'ambiguous' END AS audience FROM s")
def audience(spark, d):
    return _audience(units(spark, d)).select("doc_id", "student", "internal", "audience")


def _audience(df):
    points = lambda terms: reduce(lambda a, b: a + b, (w * F.contains(F.lower("content"), F.lit(t)).cast("int") for t, w in terms)).cast("long")
    s = df.withColumns({"student": points(STUDENT), "internal": points(INTERNAL)})
    x, y = F.col("student"), F.col("internal")
    return s.withColumn("audience", F.when((x == 0) & (y == 0), "ambiguous").when((y >= 4) & (x < 2), "internal_heavy").when(x > y, "student").when(y > x, "internal").otherwise("ambiguous"))


_AUDIENCE = "spoken AS (SELECT *, " + " + ".join(f"{w} * contains(lower(content), '{t}')::INT" for t, w in STUDENT) + " student, " + " + ".join(f"{w} * contains(lower(content), '{t}')::INT" for t, w in INTERNAL) + " internal FROM flagged), heard AS (SELECT *, CASE WHEN student = 0 AND internal = 0 THEN 'ambiguous' WHEN internal >= 4 AND student < 2 THEN 'internal_heavy' WHEN student > internal THEN 'student' WHEN internal > student THEN 'internal' ELSE 'ambiguous' END audience FROM spoken)"

#: What a service unit becomes; the first that holds.
SERVICE = [
    ("truncated", "low_quality", "truncated"), ("artifact OR reference", "rag_only", "artifact_or_reference"), ("field_label", "low_quality", "field_label"), ("mixed", "low_quality", "mixed_scope"), ("sectioned AND placeholder", "needs_review", "placeholders"),
    ("invalid OR (toc AND NOT sectioned)", "low_quality", "missing_sections"), ("noise AND words < 100", "low_quality", "severe_flags"), ("noise", "needs_review", "blocking_flags"), ("audience = 'internal_heavy'", "needs_review", "internal"), ("audience = 'ambiguous' AND student = 0", "needs_review", "no_student_signal"),
    ("parent NOT IN ('en', 'fr', 'de', 'es')", "needs_review", "unexpected_parser"), ("missing_office OR missing_who", "needs_review", "missing_fields"), ("blank_list AND few_steps", "needs_review", "blank_checklist"), ("no_steps", "needs_review", "no_steps"), ("no_time", "needs_review", "no_total_time"), ("few_steps", "needs_review", "incomplete_steps"),
]
FINE = ("recommended", "complete")
#: What a unit's own bucket still allows.
FLOORS = {"needs_review": ["needs_review", "low_quality", "rag_only"], "low_quality": ["low_quality", "rag_only"], "rag_only": ["rag_only"]}
_DECIDED = f"decided AS (SELECT *, {decided_sql(SERVICE, FINE, 0)} service_bucket, {decided_sql(SERVICE, FINE, 1)} service_reason FROM heard), floored AS (SELECT * REPLACE (CASE " + " ".join(f"WHEN bucket = '{b}' AND NOT list_contains({allowed}, service_bucket) THEN '{b}'" for b, allowed in FLOORS.items()) + " ELSE service_bucket END AS service_bucket) FROM decided)"


def decided_units(spark, d, once=False):
    """With `once`, flags are written before they are read, since every decision that reads one would work it out again."""
    heard = _audience(flagged(spark, d))
    out = (written(heard) if once else heard).withColumn("x", decided(SERVICE, FINE)).withColumns({"service_bucket": F.col("x.bucket"), "service_reason": F.col("x.reason")}).drop("x")
    floor = F.coalesce(*(F.when((F.col("bucket") == b) & ~F.col("service_bucket").isin(allowed), F.lit(b)) for b, allowed in FLOORS.items()), F.col("service_bucket"))
    return out.withColumn("service_bucket", floor)


@query("C31_decision", f"WITH {_BASE}, {_AUDIENCE}, {_DECIDED} SELECT doc_id, service_bucket AS bucket, service_reason AS reason FROM floored")
def decision(spark, d):
    """The bucket of a unit read as a service, never better than its quality allows."""
    return decided_units(spark, d).select("doc_id", F.col("service_bucket").alias("bucket"), F.col("service_reason").alias("reason"))


#: How a unit is tagged for articles.
TAGS = [
    ("generic_title AND generic_topic", "rag_only", "generic"), ("invalid", "invalid", "invalid_extraction"), ("hard_negative", "rag_only", "hard_negative"), ("long_title", "rag_only", "long_title"), ("action_fragment", "rag_only", "action_fragment"), ("person", "rag_only", "person"),
    ("incomplete", "rag_only", "incomplete_title"), ("weak_title", "rag_only", "weak_title"), ("artifact", "rag_only", "artifact_title"), ("service AND (reference OR noise OR truncated)", "rag_only", "service_reject"), ("service AND mixed", "eligible_low_quality", "service_mixed"),
    ("service AND service_bucket = 'rag_only'", "not_eligible", "service_bucket"), ("service", "eligible_procedure", "service"), ("matches(content, '(?i)licen[sc]e')", "eligible_requirement", "intent"), ("words >= 20 AND sectioned", "eligible", "sections"), ("parent = 'en' AND words >= 50", "eligible", "rescued"),
]
UNTAGGED = ("rag_only", "no_intent")


@query("C29_tag_units", f"WITH {_BASE}, {_AUDIENCE}, {_DECIDED} SELECT doc_id, {decided_sql(TAGS, UNTAGGED, 0)} AS tag, {decided_sql(TAGS, UNTAGGED, 1)} AS reason, coalesce(path, 'General > ' || topic) AS office FROM floored")
def tag_units(spark, d):
    x = decided(TAGS, UNTAGGED, "tag", "reason")
    return decided_units(spark, d).select("doc_id", x.alias("x"), F.coalesce("path", F.concat(F.lit("General > "), "topic")).alias("office")).select("doc_id", "x.tag", "x.reason", "office")


#: What keeps an article from being published; the first is told.
PUBLISH = [("title = ''", "no title", ""), ("content = '' OR truncated", "no content", ""), ("placeholder", "placeholder text", ""), ("field_label", "field label", ""), ("bucket = 'rag_only'", "for retrieval only", ""), ("bucket = 'low_quality'", "low quality", ""), ("bucket = 'needs_review' AND len_reasons > 1", "needs review", "")]


@query("F16_publish_gate", f"WITH {_BASE}, g AS (SELECT *, len(reasons) len_reasons FROM flagged) SELECT doc_id, nullif({decided_sql(PUBLISH, ('', ''), 0)}, '') AS error FROM g")
def publish_gate(spark, d):
    g = flagged(spark, d).withColumn("len_reasons", F.size("reasons"))
    return g.select("doc_id", decided(PUBLISH, ("", ""), "error", "why").alias("x")).select("doc_id", F.nullif("x.error", F.lit("")).alias("error"))


#: Everything that a recommended article must not be.
GATE = [
    ("review_reasons", "len_score_reasons > 0 OR len_reasons > 0"), ("title", "generic_title OR weak_title OR incomplete OR artifact"), ("type", "NOT service AND NOT sectioned"), ("usefulness", "usefulness <= 0"), ("confidence", "confidence < 0.6"),
    ("quality", "quality < CASE WHEN type IN ('requirement', 'procedure') THEN 7.0 ELSE 7.5 END"), ("summary", "NOT matches(content, '(?s)^.{30,}[.]')"),
]


@query("F17_recommendation_gate", f"WITH {_BASE}, g AS (SELECT *, len(reasons) len_reasons FROM flagged), n AS (SELECT doc_id, {named_sql(GATE)} failed FROM g) SELECT doc_id, len(failed) = 0 AS passes, array_to_string(failed, ',') AS failed FROM n")
def recommendation_gate(spark, d):
    g = flagged(spark, d).withColumn("len_reasons", F.size("reasons")).select("doc_id", named(GATE).alias("failed"))
    return g.select("doc_id", (F.size("failed") == 0).alias("passes"), F.array_join("failed", ",").alias("failed"))


@query("H13_client_bucket", f"WITH {_BASE}, {_AUDIENCE}, {_DECIDED}, g AS (SELECT *, len(reasons) len_reasons FROM floored) SELECT doc_id, CASE WHEN artifact THEN 'low_quality' WHEN len({named_sql(GATE)}) = 0 THEN 'recommended' WHEN service THEN service_bucket ELSE coalesce(nullif(bucket, 'pending'), 'needs_review') END AS bucket FROM g")
def client_bucket(spark, d):
    """The bucket that is shown: the gate's, then the service's, then the unit's own; what waits is for review."""
    g = decided_units(spark, d, once=True).withColumn("len_reasons", F.size("reasons"))
    shown = F.when(F.col("artifact"), "low_quality").when(F.size(named(GATE)) == 0, "recommended").when(F.col("service"), F.col("service_bucket")).otherwise(F.coalesce(F.nullif("bucket", F.lit("pending")), F.lit("needs_review")))
    return g.select("doc_id", shown.alias("bucket"))


#: What blocks a service row.
BLOCKERS = [("no_office", "missing_office"), ("no_who", "missing_who"), ("no_steps", "no_steps"), ("few_steps", "few_steps"), ("no_time", "no_time"), ("placeholder", "placeholder"), ("noise", "noise"), ("contents", "toc"), ("internal", "audience = 'internal_heavy'"), ("mixed", "mixed"), ("weak_title", "generic_title OR weak_title")]


@query("F18_blockers", f"WITH {_BASE}, {_AUDIENCE}, n AS (SELECT doc_id, {named_sql(BLOCKERS)} b FROM heard) SELECT doc_id, len(b) = 0 AS passes, array_to_string(b, ',') AS blockers FROM n")
def blockers(spark, d):
    n = _audience(flagged(spark, d)).select("doc_id", named(BLOCKERS).alias("b"))
    return n.select("doc_id", (F.size("b") == 0).alias("passes"), F.array_join("b", ",").alias("blockers"))


#: Final buckets before the cap: what is wrong first, then service rows, then the gate.
FINAL = [
    ("artifact OR field_label", "low_quality", "artifact_or_label"), ("service AND truncated", "low_quality", "incomplete_service"), ("service AND (no_steps OR few_steps)", "needs_review", "incomplete_service"), ("service AND service_bucket = 'recommended' AND blocked = 0", "recommended", "service_gate"),
    ("service AND service_bucket = 'recommended'", "needs_review", "blocked"), ("service", "needs_review", "service_review"), ("bucket = 'low_quality'", "low_quality", "kept"), ("bucket = 'rag_only'", "rag_only", "kept"), ("failed = 0", "recommended", "gate"),
]
BORDER = ("needs_review", "borderline_recommendation")
CAP = 10
_FINAL = f"{_BASE}, {_AUDIENCE}, {_DECIDED}, g AS (SELECT *, len(reasons) len_reasons FROM floored), w AS (SELECT *, len({named_sql(GATE)}) failed, len({named_sql(BLOCKERS)}) blocked FROM g), f AS (SELECT doc_id, topic, quality, words, title, {decided_sql(FINAL, BORDER, 0)} bucket, {decided_sql(FINAL, BORDER, 1)} reason FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY topic, bucket ORDER BY quality DESC, words DESC, title DESC, doc_id) k FROM f)"


def final(spark, d):
    """Bucket and reason of each unit, written, since the best of each topic are taken from them and joined back."""
    w = decided_units(spark, d, once=True).withColumn("len_reasons", F.size("reasons")).withColumns({"failed": F.size(named(GATE)), "blocked": F.size(named(BLOCKERS))})
    return w.select("doc_id", "topic", "quality", "words", "title", decided(FINAL, BORDER).alias("x")).select("doc_id", "topic", "quality", "words", "title", "x.bucket", "x.reason").checkpoint()


def best(f):
    """The CAP best recommended of each topic; the window keeps CAP rows a partition before it shuffles."""
    w = Window.partitionBy("topic").orderBy(F.desc("quality"), F.desc("words"), F.desc("title"), "doc_id")
    return f.where("bucket = 'recommended'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= CAP)


@query("W16_final_buckets", f"WITH {_FINAL} SELECT doc_id, CASE WHEN bucket = 'recommended' AND k > {CAP} THEN 'needs_review' ELSE bucket END AS bucket, CASE WHEN bucket = 'recommended' AND k > {CAP} THEN 'recommended_cap_exceeded' ELSE reason END AS reason FROM r")
def final_buckets(spark, d):
    """The cap is the feature: beyond it the rest go to review."""
    f = final(spark, d)
    out = f.join(best(f).select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").withColumn("over", (F.col("bucket") == "recommended") & F.col("kept").isNull())
    return out.select("doc_id", F.when(F.col("over"), "needs_review").otherwise(F.col("bucket")).alias("bucket"), F.when(F.col("over"), "recommended_cap_exceeded").otherwise(F.col("reason")).alias("reason"))


@query("W17_recommendation_order", f"WITH {_FINAL} SELECT doc_id, topic, k AS place FROM r WHERE bucket = 'recommended' AND k <= {CAP}")
def recommendation_order(spark, d):
    """The best recommended of each topic in their order; equal ones with the later title first."""
    return best(final(spark, d)).select("doc_id", "topic", F.col("k").cast("long").alias("place"))


@query("A12_funnel", f"WITH {_FINAL}, n AS (SELECT count(*) units FROM f) SELECT reason, bucket, count(*) AS units, floor(count(*)::DOUBLE / any_value(n.units) * 1e4 + 0.5) / 1e4 AS share FROM f, n GROUP BY reason, bucket")
def funnel(spark, d):
    """How many units leave the funnel at each decision."""
    f = final(spark, d).groupBy("reason", "bucket").agg(F.count("*").alias("units"))
    total = f.agg(F.sum("units").alias("total"))
    return f.join(F.broadcast(total)).select("reason", "bucket", "units", (F.floor(F.col("units") / F.col("total") * 1e4 + 0.5) / 1e4).alias("share"))
