"""Reading, writing and finding stored chunks and source documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import markup
from folioloom.plans.registry import query
from folioloom.sources import store
from folioloom.sources.tables import CHUNKS, chunks, table


@query("S1_route", r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\.(png|jpe?g)$') THEN 'image' ELSE 'html' END AS kind FROM pages")
def route(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").select("page_id", F.when(u.rlike(r"\.pdf$"), "pdf").when(u.rlike(r"\.(png|jpe?g)$"), "image").otherwise("html").alias("kind"))


LEAST_TEXT = 40


@query("S2_page_text", f"WITH t AS (SELECT page_id, {markup.visible_text_sql('html')} AS text FROM pages) SELECT page_id, length(text) >= {LEAST_TEXT} AS has_text, CASE WHEN text <> '' THEN 'digital' ELSE 'recognition' END AS method, 1::DOUBLE AS geometry_scale, text FROM t")
def page_text(spark, d):
    """A page's text layer, whether it is long enough to do without recognition, and which of the two its text comes from; nothing recognises here, so a short layer is kept as it is."""
    t = table(spark, d, "pages").select("page_id", markup.visible_text("html").alias("text"))
    return t.select("page_id", (F.length("text") >= LEAST_TEXT).alias("has_text"), F.when(F.col("text") != "", "digital").otherwise("recognition").alias("method"), F.lit(1.0).alias("geometry_scale"), "text")


@query("S3_word_boxes", "SELECT l_orderkey, l_linenumber, l_extendedprice AS x0, (l_quantity + l_quantity + 9) / 2 AS cy, greatest(1, l_tax * 100)::DOUBLE AS height FROM lineitem")
def word_boxes(spark, d):
    """Centre and height of boxes given by two edges."""
    y0, y1 = F.col("l_quantity"), F.col("l_quantity") + 9
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x0"), ((y0 + y1) / 2).alias("cy"), F.greatest(F.lit(1.0), F.col("l_tax") * 100).alias("height"))


@query("S4_table_regions", "SELECT page_id, len(regexp_extract_all(html, '(?i)<tr'))::BIGINT AS table_rows, len(regexp_extract_all(html, '(?i)<li'))::BIGINT AS list_items FROM pages")
def table_regions(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, d, "pages").select("page_id", n("(?i)<tr").alias("table_rows"), n("(?i)<li").alias("list_items"))


_ITEM = rf"regexp_extract_all(region, '(?s)<li>(.*?)</li>', 1)"


@query(
    "S4_page_tables",
    rf"""WITH r AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '(?s)<[uo]l>.*?</[uo]l>')))) n, unnest(regexp_extract_all(html, '(?s)<[uo]l>(.*?)</[uo]l>', 1)) region FROM pages)
 SELECT page_id, n, 'list' AS kind, len({_ITEM}) AS rows, least(len({_ITEM}), 1) AS columns, sha256(array_to_string(list_transform({_ITEM}, lambda x: {markup.visible_text_sql('x')}), chr(10))) AS cells_sha256 FROM r""",
)
def page_tables(spark, d):
    """Every table and list of a page with its size and cells. The tables here hold plain lists only, which is what the SQL reads; spans, nesting and broken markup are tested by themselves."""
    r = markup.with_regions(table(spark, d, "pages").select("page_id", "html"), "html").select("page_id", F.posexplode("regions").alias("n", "r"))
    cells = F.array_join(F.transform("r.rows", lambda row: F.array_join(row, "\t")), "\n")
    wide = F.coalesce(F.array_max(F.transform("r.rows", F.size)), F.lit(0))
    return r.select("page_id", F.col("n").cast("long").alias("n"), "r.kind", F.size("r.rows").cast("long").alias("rows"), wide.cast("long").alias("columns"), F.sha2(cells, 256).alias("cells_sha256"))


@query("S5_reading_score", r"WITH s AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1)::DOUBLE a, length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) / greatest(length(text), 1)::DOUBLE s, len(regexp_extract_all(text, '\S+')) w FROM documents) SELECT doc_id, floor((3 * 0.9 + a + least(w / 40.0, 1) - s) * 1e6 + 0.5) / 1e6 AS score FROM s")
def reading_score(spark, d):
    """How well a text reads: three times the mean confidence, plus letters, plus length, less symbols."""
    n = F.greatest(F.length("text"), F.lit(1))
    a = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / n
    s = F.length(F.regexp_replace("text", r"[A-Za-z0-9\s]", "")) / n
    w = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", (F.floor((F.lit(3 * 0.9) + a + F.least(w / F.lit(40.0), F.lit(1.0)) - s) * 1e6 + 0.5) / 1e6).alias("score"))


@query("S7_multipage", f"WITH {CHUNKS} SELECT doc_id, string_agg('--- Page ' || (chunk_index + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY doc_id")
def multipage(spark, d):
    line = F.concat(F.lit("--- Page "), (F.col("chunk_index") + 1).cast("string"), F.lit(" ---\n"), "text")
    return chunks(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


@query("S8_scan", f"WITH {CHUNKS} SELECT doc_id || '::' || chunk_index AS chunk_id, doc_id AS document_id, lang AS doc_lang, length(text)::BIGINT AS size FROM chunks")
@query("S10_stored_rows", f"WITH {CHUNKS} SELECT doc_id || '::' || chunk_index AS chunk_id, doc_id AS document_id, lang AS doc_lang, length(text)::BIGINT AS size FROM chunks")
def scan(spark, d):
    return store.chunk_rows(chunks(spark, d)).select("chunk_id", "document_id", F.col("metadata")["doc_lang"].alias("doc_lang"), F.length("text").cast("long").alias("size"))


@query("S9_point", f"WITH {CHUNKS} SELECT doc_id || '::' || chunk_index AS chunk_id, text FROM chunks WHERE doc_id = 77 AND chunk_index = 0")
def point(spark, d):
    """One chunk by its id; the document's part of the id reaches the scan as a pushed filter."""
    return store.chunk_rows(chunks(spark, d).where("doc_id = 77")).where("chunk_id = '77::0'").select("chunk_id", "text")


@query("S11_delete", f"WITH {CHUNKS} SELECT doc_id AS document_id, count(*) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id")
def delete(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return store.without_documents(store.chunk_rows(chunks(spark, d)), ids).groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("S12_delete_by_name", "SELECT source AS file, count(*) AS rows FROM documents WHERE lower(source) <> 'src3' GROUP BY source")
def delete_by_name(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("file"))
    return store.without_file(rows, "SRC3").groupBy("file").agg(F.count("*").alias("rows"))


@query("S13_reset", f"WITH {CHUNKS} SELECT count(*) AS removed, 0::BIGINT AS left FROM chunks")
def reset(spark, d):
    left = store.empty(spark).agg(F.count("*").alias("left"))
    return chunks(spark, d).agg(F.count("*").alias("removed")).crossJoin(F.broadcast(left))


@query("S14_rebuild_summary", f"WITH {CHUNKS}, p AS (SELECT source, count(*) documents, count_if(coalesce(trim(text), '') = '') empty, min(doc_id) FILTER (WHERE coalesce(trim(text), '') = '') first_empty FROM documents GROUP BY source), c AS (SELECT source, count(*) chunks, count(DISTINCT lang) categories FROM chunks GROUP BY source) SELECT source AS path, documents, coalesce(chunks, 0) AS chunks, coalesce(categories, 0) AS categories, empty AS failed, first_empty AS first_failure, CASE WHEN coalesce(chunks, 0) = 0 THEN 'failed' WHEN empty > 0 THEN 'partial' ELSE 'indexed' END AS state FROM p LEFT JOIN c USING (source)")
def rebuild_summary(spark, d):
    """A rebuild path by path: what was read and cut into chunks, what failed, and how far each path came; one path's failure leaves the others alone."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    p = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(blank).alias("failed"), F.min(F.when(blank, F.col("doc_id"))).alias("first_failure"))
    c = chunks(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("lang").alias("categories"))
    state = F.when(F.col("chunks") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("indexed")
    return p.join(c, "source", "left").fillna(0, ["chunks", "categories"]).select(F.col("source").alias("path"), "documents", "chunks", "categories", "failed", "first_failure", state.alias("state"))


@query("S15_taxonomy_rows", "SELECT c AS category, s AS subcategory, row_number() OVER (ORDER BY c, s) AS ord FROM (SELECT DISTINCT lang c, source s FROM documents WHERE source <> '')")
def taxonomy_rows(spark, d):
    """Nested configuration as ordered rows; the configuration is small, so one sorted array holds it."""
    nested = table(spark, d, "documents").where("source <> ''").select(F.struct(F.col("lang").alias("category"), F.col("source").alias("subcategory")).alias("x")).distinct().agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return nested.select(F.posexplode("xs").alias("p", "x")).select("x.category", "x.subcategory", (F.col("p") + 1).cast("long").alias("ord"))


@query("S16_seed_aliases", "SELECT n_nationkey AS office_id, lower(n_name) AS alias FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def seed_aliases(spark, d):
    """Only aliases that are not there yet."""
    there = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("office_id"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("office_id"), F.lower("n_name").alias("alias")).join(there, "office_id", "left_anti")


@query("S17_upsert", "SELECT user_id AS k, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), "event_type", F.struct("ts", "event_id").alias("v"))
    old, new = (e.where(f"v.event_id % 2 = {i}").withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v")))).where("_r = 1").drop("_r") for i in (0, 1))
    return store.upsert(old, new, "k", "v").select("k", "event_type", F.col("v.ts").alias("ts"))


@query("S18_find_source", "WITH q AS (SELECT * FROM (VALUES ('src1'), ('SRC2'), ('rc19'), ('none')) t(asked)), s AS (SELECT source, max(doc_id) latest FROM documents GROUP BY source), m AS (SELECT asked, source, latest, CASE WHEN source = asked THEN 0 WHEN lower(source) = lower(asked) THEN 1 WHEN contains(lower(source), lower(asked)) THEN 2 END tier FROM q CROSS JOIN s) SELECT asked, arg_min(source, struct_pack(a := tier, b := -latest)) AS source, min(tier)::BIGINT AS tier FROM m WHERE tier IS NOT NULL GROUP BY asked")
def find_source(spark, d):
    """The best match of each asked name among the distinct sources."""
    asked = spark.createDataFrame([("src1",), ("SRC2",), ("rc19",), ("none",)], "asked string")
    s = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("latest"))
    low = F.lower("source")
    tier = F.when(F.col("source") == F.col("asked"), 0).when(low == F.lower("asked"), 1).when(F.contains(low, F.lower("asked")), 2)
    m = s.join(F.broadcast(asked), F.contains(low, F.lower("asked"))).withColumn("tier", tier.cast("long"))
    return m.groupBy("asked").agg(F.min_by("source", F.struct("tier", -F.col("latest"))).alias("source"), F.min("tier").alias("tier"))


@query("S19_single_page", f"WITH {CHUNKS} SELECT doc_id, text FROM chunks WHERE chunk_index = 2")
def single_page(spark, d):
    return chunks(spark, d).where("chunk_index = 2").select("doc_id", "text")
