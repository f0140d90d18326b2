"""Articles planned from units, and services merged from their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import merging
from folioloom.plans.registry import query
from folioloom.sources.tables import table

_WORDS = r"regexp_extract_all(text, '\S+')"
#: A unit's parent and topic are its first two words, its root is its language.
PLANNED = rf"""planned AS (SELECT doc_id ord, CASE WHEN coalesce({_WORDS}[1], '') = '' THEN '{merging.NO_PARENT}' ELSE {_WORDS}[1] END parent, CASE WHEN coalesce({_WORDS}[2], '') = '' THEN '{merging.NO_TOPIC}' ELSE {_WORDS}[2] END topic, lang root,
 CASE WHEN contains(text, ' | ') THEN 'form' WHEN len({_WORDS}) > 500 THEN 'policy' END AS type FROM documents)"""
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
_NOTHING = lambda x: f"(length({_KEY(x)}) <= 2 OR regexp_matches({_KEY(x)}, '^[0-9 ]*$'))"
_SCOPED = lambda s, t: f"CASE WHEN starts_with(lower({t}), lower({s})) THEN {t} ELSE {s} || ' ' || {t} END"
_ID = "sha1(lower(parent) || '|' || lower({}))".format
_COHERENT = f"topics <= {merging.MOST_TOPICS} AND types <= {merging.MOST_TYPES} AND roots <= {merging.MOST_ROOTS}"
_N = merging.LEAST_UNITS


def planned(spark, d):
    t, w = table(spark, d, "documents"), F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    kind = F.when(F.contains("text", F.lit(" | ")), "form").when(F.size(w) > 500, "policy")
    return t.select(F.col("doc_id").alias("ord"), F.get(w, F.lit(0)).alias("parent"), F.get(w, F.lit(1)).alias("topic"), F.col("lang").alias("root"), kind.alias("type"))


@query(
    "D3_blueprints",
    f"""WITH {PLANNED}, u AS (SELECT *, {_KEY('topic')} k FROM planned),
 p AS (SELECT parent, count(*) units, min(ord) lead, count(DISTINCT k) keys, count(DISTINCT nullif(k, '')) topics, count(DISTINCT type) types, count(DISTINCT root) roots, min(root) scope FROM u GROUP BY parent),
 w AS (SELECT *, keys >= {_N} AND units >= {_N} AND roots <= 1 AND {_COHERENT} AND NOT {_NOTHING('parent')} whole FROM p),
 s AS (SELECT parent, k, count(DISTINCT coalesce(root, parent)) split FROM u GROUP BY parent, k),
 r AS (SELECT u.*, CASE WHEN split > 1 THEN coalesce(root, u.parent) END part FROM u JOIN s ON u.parent = s.parent AND u.k = s.k JOIN w ON u.parent = w.parent WHERE NOT whole),
 g AS (SELECT parent, k, part, count(*) units, min(ord) lead, arg_min(topic, ord) topic, count(DISTINCT topic) spellings, count(DISTINCT nullif(k, '')) topics, count(DISTINCT type) types, count(DISTINCT root) roots, min(root) scope FROM r GROUP BY parent, k, part),
 h AS (SELECT * REPLACE (CASE WHEN units >= {_N} AND spellings > 1 THEN parent ELSE topic END AS topic) FROM g),
 i AS (SELECT * REPLACE (CASE WHEN part IS NULL THEN topic ELSE {_SCOPED('part', 'topic')} END AS topic) FROM h),
 f AS (SELECT parent, parent topic, scope, units, lead, true consolidated, true coherent FROM w WHERE whole
  UNION ALL SELECT parent, topic, scope, units, lead, units >= {_N} AND NOT {_NOTHING('parent')} AND {_COHERENT}, NOT (units >= {_N} AND NOT {_NOTHING('parent')}) OR ({_COHERENT}) FROM i WHERE NOT {_NOTHING('topic')}),
 o AS (SELECT *, {_KEY('topic')} k FROM f QUALIFY row_number() OVER (PARTITION BY {_ID('topic')} ORDER BY units DESC, lead) = 1),
 t AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) > 1 AND scope IS NOT NULL THEN {_SCOPED('scope', 'topic')} ELSE topic END title FROM o),
 v AS (SELECT * REPLACE (CASE WHEN {_KEY('parent')} = k AND title <> topic THEN title ELSE parent END AS parent) FROM t)
 SELECT {_ID('title')} AS id, parent, title AS topic, units, lead, consolidated, coherent FROM v""",
)
def blueprints(spark, d):
    """Articles from documents; a title of at most two letters says nothing."""
    return merging.blueprints(planned(spark, d), lambda k: F.length(k) <= 2)


#: A document is a part of the service that its first word names; fields are what its text shows, items its lines.
_MAIL, _NUMBER = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[0-9]+(?:[.][0-9]+)?"
_OFFICE = r"trim(regexp_replace(lower(coalesce(office, '')), '[^\p{L}\p{N}_\s]+', ' ', 'g'))"
SERVICES = rf"""named AS (SELECT doc_id, lower(regexp_extract(text, '\S+')) w, CASE WHEN doc_id % 23 = 0 THEN '{merging.MISSING}' ELSE source END office, regexp_extract(text, '{_MAIL}') mail, regexp_extract(text, '{_NUMBER}') number, text FROM documents),
 services AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(w, '^[ :–—-]+|[ :–—-]+$', '', 'g'), '[^\p{{L}}\p{{N}}_\s/]+', ' ', 'g'), '\s+', ' ', 'g')) AS key, CASE WHEN office = '{merging.MISSING}' THEN '' ELSE {_OFFICE} END o, office, mail, number, text FROM named)"""


def services(spark, d):
    """Parts of services; every third title has one kind of part number, every third the other."""
    word = F.regexp_extract("text", r"\S+", 0)
    number = (F.col("doc_id") % 7 + 1).cast("string")
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(word, F.lit(" - Part "), number)).when(F.col("doc_id") % 3 == 1, F.concat(word, F.lit(" ( part "), number, F.lit(")"))).otherwise(word)
    return table(spark, d, "documents").select(
        "doc_id", merging.merge_key(title).alias("key"), F.when(F.col("doc_id") % 23 == 0, merging.MISSING).otherwise(F.col("source")).alias("office"),
        F.regexp_extract("text", _MAIL, 0).alias("mail"), F.regexp_extract("text", _NUMBER, 0).alias("number"), F.split("text", "\n").alias("items"),
    )


@query(
    "D5_merged_parts",
    rf"""WITH {SERVICES}, a AS (SELECT key, min(doc_id) lead, arg_min(o, doc_id) FILTER (WHERE o <> '') a FROM services WHERE key <> '' GROUP BY key),
 m AS (SELECT s.*, CASE WHEN a IS NULL OR o = '' OR contains(a, o) OR contains(o, a) THEN lead ELSE doc_id END head FROM services s JOIN a ON s.key = a.key),
 f AS (SELECT key, head, count(*) parts, arg_min(office, doc_id) FILTER (WHERE o <> '') office, arg_min(mail, doc_id) FILTER (WHERE mail <> '') mail, arg_min(number, doc_id) FILTER (WHERE number <> '') number FROM m GROUP BY key, head),
 l AS (SELECT head, doc_id, unnest(range(len(string_split(text, chr(10))))) n, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) item FROM m),
 q AS (SELECT head, lower(item), arg_min(item, struct_pack(a := doc_id, b := n)) item, min(struct_pack(a := doc_id, b := n)) place FROM l WHERE item <> '' AND item <> '{merging.MISSING}' GROUP BY 1, 2),
 i AS (SELECT head, count(*) items, sha256(string_agg(item, chr(10) ORDER BY place)) digest FROM q GROUP BY head)
 SELECT key, head, parts, office, mail, number, coalesce(items, 0) AS items, coalesce(digest, sha256('')) AS items_sha256 FROM f LEFT JOIN i USING (head)""",
)
def merged_parts(spark, d):
    """Services of documents; the office of a group decides which parts it takes."""
    out = merging.merge_parts(services(spark, d), "key", "doc_id", "office", ["mail", "number"], ["items"])
    return out.select("key", "head", "parts", "office", "mail", "number", F.size("items").cast("long").alias("items"), F.sha2(F.array_join("items", "\n"), 256).alias("items_sha256"))
