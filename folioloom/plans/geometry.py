"""Layout, service tables and unit building. Word boxes are laid over order lines, since no table has boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.operators import layout

from folioloom.plans.registry import query
from folioloom.plans.structure import HEADING
from folioloom.sources.tables import LINES, lines, table

BOXES = "boxes AS (SELECT l_orderkey page, l_partkey * 100000 + l_suppkey * 10 + l_linenumber word, l_returnflag || l_linenumber AS text, l_extendedprice / 100 AS x0, l_extendedprice / 100 + 30 AS x1, l_quantity AS cy, 4.0::DOUBLE AS height, floor(l_quantity / 20)::INT AS row FROM lineitem)"


def boxes(spark, d):
    x0 = F.col("l_extendedprice") / 100
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("word"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), x0.alias("x0"), (x0 + 30).alias("x1"), F.col("l_quantity").alias("cy"), F.lit(4.0).alias("height"))


def gridded(spark, d):
    return boxes(spark, d).withColumn("row", F.floor(F.col("cy") / 20).cast("int"))


@query("W1_row_clusters")
def row_clusters(spark, d):
    """Rows by running mean; sequential, so tested against brute force."""
    return layout.rows(boxes(spark, d)).groupBy("page").agg(F.max("row").alias("last_row"), F.count("*").alias("words"))


@query("W2_row_text", f"WITH {BOXES}, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, row ORDER BY x0, word) > greatest(2 * height, 18) THEN '| ' ELSE '' END || text piece FROM boxes) SELECT page, row, string_agg(piece, ' ' ORDER BY x0, word) AS text FROM m GROUP BY page, row")
def row_text(spark, d):
    return layout.row_text(gridded(spark, d))


_BOUNDS = "g AS (SELECT *, lead(x0) OVER (PARTITION BY page, row ORDER BY x0, word) nxt FROM boxes), k AS (SELECT *, row_number() OVER (PARTITION BY page, row ORDER BY nxt - x1 DESC, x0, word) k FROM g WHERE nxt - x1 >= 8), bounds AS (SELECT page, row, list((x1 + nxt) / 2 ORDER BY (x1 + nxt) / 2) b FROM k WHERE k < 3 GROUP BY page, row)"


@query("W3_column_bounds", f"WITH {BOXES}, {_BOUNDS} SELECT page, row, len(b) AS bounds, floor(b[1] * 1e3 + 0.5) / 1e3 AS first_bound FROM bounds")
def column_bounds(spark, d):
    b = layout.boundaries(gridded(spark, d), 3, 8.0)
    return b.select("page", "row", F.size("bounds").cast("long").alias("bounds"), (F.floor(F.get("bounds", F.lit(0)) * 1e3 + 0.5) / 1e3).alias("first_bound"))


@query("W4_columns", f"WITH {BOXES}, {_BOUNDS} SELECT page, row, word, len(list_filter(b, lambda v: x0 >= v)) AS col FROM boxes JOIN bounds USING (page, row)")
def columns(spark, d):
    g = gridded(spark, d)
    return g.join(layout.boundaries(g, 3, 8.0), ["page", "row"]).select("page", "row", "word", layout.column_of(F.col("x0"), F.col("bounds")).cast("long").alias("col"))


@query("X2_packed_paragraphs")
def packed_paragraphs(spark, d):
    """Paragraphs packed to 1,200 characters, each piece after the first beginning with the last 150 of the one before."""
    made = table(spark, d, "documents").select("doc_id", layout.packed(F.split("text", "\n"), 1200, overlap=150).alias("parts"))
    return made.select("doc_id", F.posexplode("parts").alias("chunk_index", "text")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("size"))


@query("X7_units", f"WITH {LINES}, b AS (SELECT doc_id, line_no, line, sum(regexp_matches(line, '{HEADING}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) unit FROM lines) SELECT doc_id, unit::BIGINT AS unit, arg_min(line, line_no) AS title, string_agg(line, chr(10) ORDER BY line_no) AS body FROM b GROUP BY doc_id, unit")
def units(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    b = lines(spark, d).withColumn("unit", F.sum(F.col("line").rlike(HEADING).cast("int")).over(w))
    return b.groupBy("doc_id", "unit").agg(F.min_by("line", "line_no").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))


@query("X8_listing", r"WITH p AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) program FROM documents) SELECT source AS college, lower(program) AS program, count(DISTINCT doc_id) AS places FROM p GROUP BY 1, 2")
def listing(spark, d):
    p = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))).alias("program"))
    return p.groupBy(F.col("source").alias("college"), F.lower("program").alias("program")).agg(F.count_distinct("doc_id").alias("places"))


@query("X9_embedded_forms", f"WITH {LINES}, p AS (SELECT doc_id, line_no, contains(line, '|') form FROM lines) SELECT doc_id, count(*) FILTER (WHERE form) AS form_lines, count(*) FILTER (WHERE NOT form) AS body_lines FROM p GROUP BY doc_id HAVING count(*) FILTER (WHERE form) > 0")
def embedded_forms(spark, d):
    form = F.contains("line", F.lit("|"))
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(form).alias("form_lines"), F.count_if(~form).alias("body_lines")).where("form_lines > 0")


@query("X10_service_blocks", f"WITH {LINES}, b AS (SELECT doc_id, line_no, line, sum(regexp_matches(line, '{HEADING}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) block FROM lines) SELECT doc_id, block::BIGINT AS block, count_if(contains(line, '|')) AS steps, count_if(regexp_matches(line, '(?i)licen[sc]e')) AS requirements FROM b GROUP BY doc_id, block")
def service_blocks(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    b = lines(spark, d).withColumn("block", F.sum(F.col("line").rlike(HEADING).cast("int")).over(w))
    return b.groupBy("doc_id", "block").agg(F.count_if(F.contains("line", F.lit("|"))).alias("steps"), F.count_if(F.col("line").rlike("(?i)licen[sc]e")).alias("requirements"))


@query("D12_bound_placeholders", f"WITH {LINES}, h AS (SELECT doc_id, line_no, line, regexp_matches(line, '{HEADING}') head FROM lines), n AS (SELECT *, lead(head) OVER w nh, lead(line) OVER w nl FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no::BIGINT AS line_no, line AS title, CASE WHEN nh THEN NULL ELSE nl END AS bound FROM n WHERE head")
def bound_placeholders(spark, d):
    """A heading binds to the line that follows unless that is a heading too."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    h = lines(spark, d).withColumn("head", F.col("line").rlike(HEADING)).withColumn("nh", F.lead("head").over(w)).withColumn("nl", F.lead("line").over(w))
    return h.where("head").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("title"), F.when(~F.coalesce("nh", F.lit(False)), F.col("nl")).alias("bound"))


__all__ = ["tf"]
