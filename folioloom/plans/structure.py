"""Lines, headings, tables, chunks and lists found in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf
from folioloom.plans.registry import query
from folioloom.sources.tables import CHUNKS, LINES, chunks, lines, table

HEADING = r"^[A-ZÀ-Ü][^.|]{2,30}\.$"


@query("W5_blocks", f"WITH {LINES}, b AS (SELECT doc_id, line_no, sum(regexp_matches(line, '{HEADING}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) block FROM lines) SELECT doc_id, block::BIGINT AS block, min(line_no)::BIGINT AS first_line, count(*) AS lines FROM b GROUP BY doc_id, block")
def blocks(spark, d):
    """A heading opens a block that runs to the next."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    b = lines(spark, d).withColumn("block", F.sum(F.col("line").rlike(HEADING).cast("int")).over(w))
    return b.groupBy("doc_id", "block").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("lines"))


@query("W6_context", f"WITH {LINES}, h AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[A-Z][a-z]+\\.$') THEN line END chapter, CASE WHEN regexp_matches(line, '{HEADING}') THEN line END section FROM lines) SELECT doc_id, line_no::BIGINT AS line_no, last_value(chapter IGNORE NULLS) OVER w AS chapter, last_value(section IGNORE NULLS) OVER w AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)".replace("\\\\", "\\"))
def context(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    chapter, section = F.when(F.col("line").rlike(r"^[A-Z][a-z]+\.$"), F.col("line")), F.when(F.col("line").rlike(HEADING), F.col("line"))
    return lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.last(chapter, True).over(w).alias("chapter"), F.last(section, True).over(w).alias("section"))


@query("W7_sections", f"WITH {LINES}, h AS (SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '{HEADING}')) SELECT doc_id, line AS heading, line_no::BIGINT AS start, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS stop FROM h")
def sections(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines(spark, d).where(F.col("line").rlike(HEADING)).select("doc_id", F.col("line").alias("heading"), F.col("line_no").cast("long").alias("start"), F.lead("line_no").over(w).cast("long").alias("stop"))


@query("W8_tables", f"WITH {LINES}, p AS (SELECT doc_id, line_no, line, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) g FROM lines WHERE contains(line, '|')) SELECT doc_id, min(line_no)::BIGINT AS first_line, count(*) - 1 AS rows, arg_min(line, line_no) AS header, max(len(string_split(line, '|')))::BIGINT AS columns FROM p GROUP BY doc_id, g")
def tables(spark, d):
    """Islands of consecutive piped lines; the first is the header."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    p = lines(spark, d).where(F.contains("line", F.lit("|"))).withColumn("g", F.col("line_no") - F.row_number().over(w))
    return p.groupBy("doc_id", "g").agg(F.min("line_no").cast("long").alias("first_line"), (F.count("*") - 1).alias("rows"), F.min_by("line", "line_no").alias("header"), F.max(F.size(F.split("line", r"\|"))).cast("long").alias("columns")).drop("g")


@query("W9_short_runs", f"WITH {LINES}, s AS (SELECT doc_id, line_no, line, length(line) < 40 short, line_no - row_number() OVER (PARTITION BY doc_id, length(line) < 40 ORDER BY line_no) g FROM lines) SELECT doc_id, min(line_no)::BIGINT AS first_line, count(*) AS merged, string_agg(line, ' ' ORDER BY line_no) AS text FROM s WHERE short GROUP BY doc_id, g HAVING count(*) >= 3")
def short_runs(spark, d):
    s = lines(spark, d).withColumn("short", F.length("line") < 40)
    s = s.withColumn("g", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id", "short").orderBy("line_no"))).where("short")
    g = s.groupBy("doc_id", "g").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("merged"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))
    return g.where("merged >= 3").drop("g")


@query("W11_packed", None)
def packed(spark, d):
    """Greedy packing of a document's lines into parts of at most 120 words, as one fold over the array."""
    n = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("now"))
    step = lambda acc, x: F.when((acc["now"] > 0) & (acc["now"] + x > 120), F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), x.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), (acc["now"] + x).alias("now")))
    sizes = F.transform(F.split("text", "\n"), n)
    folded = table(spark, d, "documents").select("doc_id", F.aggregate(sizes, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"]))).alias("parts"))
    return folded.select("doc_id", F.size("parts").cast("long").alias("parts"), F.array_max("parts").cast("long").alias("largest"))


@query("X1_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_index, char_start, text FROM chunks")
def fixed_chunks(spark, d):
    return chunks(spark, d).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), "text")


@query("X3_service_chunks", "WITH s AS (SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ', ' ORDER BY l_linenumber, l_returnflag) steps, sum(l_quantity)::INT total FROM lineitem GROUP BY 1) SELECT l_orderkey, 'steps' AS kind, 'Steps: ' || steps AS text FROM s UNION ALL SELECT l_orderkey, 'total', 'Total: ' || total FROM s")
def service_chunks(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))), ", ").alias("steps"), F.sum("l_quantity").cast("int").alias("total"))
    both = F.explode(F.array(F.struct(F.lit("steps").alias("kind"), F.concat(F.lit("Steps: "), "steps").alias("text")), F.struct(F.lit("total").alias("kind"), F.concat(F.lit("Total: "), F.col("total").cast("string")).alias("text"))))
    return s.select("l_orderkey", both.alias("x")).select("l_orderkey", "x.*")


@query("X4_typed_chunks", f"WITH {LINES}, t AS (SELECT doc_id, line_no, CASE WHEN contains(line, '|') THEN 'table' WHEN regexp_matches(line, '{HEADING}') THEN 'heading' ELSE 'text' END kind, length(line) n FROM lines) SELECT doc_id, line_no::BIGINT AS line_no, kind, (sum(n + 2) OVER (PARTITION BY doc_id ORDER BY line_no) - n - 2)::BIGINT AS char_start FROM t")
def typed_chunks(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kind = F.when(F.contains("line", F.lit("|")), "table").when(F.col("line").rlike(HEADING), "heading").otherwise("text")
    t = lines(spark, d).select("doc_id", "line_no", kind.alias("kind"), F.length("line").alias("n"))
    return t.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", (F.sum(F.col("n") + 2).over(w) - F.col("n") - 2).alias("char_start"))


@query("X5_json_chunks", "SELECT page_id, json_extract_string(json_object('url', url, 'n', length(html)), '$.url') AS url, (json_object('url', url, 'n', length(html)) ->> '$.n')::BIGINT AS n FROM pages")
def json_chunks(spark, d):
    meta = F.to_json(F.struct("url", F.length("html").alias("n")))
    return table(spark, d, "pages").select("page_id", F.from_json(meta, "url string, n long").alias("m")).select("page_id", "m.url", "m.n")


@query("X6_preview", f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, arg_min(substring(text, 1, 100), chunk_index) AS preview FROM chunks GROUP BY doc_id")
def preview(spark, d):
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min_by(F.substring("text", 1, 100), "chunk_index").alias("preview"))


@query("X11_form_fields", f"WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, trim(regexp_extract(line, '^([A-Za-z ]+?) ?\\|', 1)) AS field FROM lines WHERE regexp_matches(line, '^[A-Za-z ]+\\|')".replace("\\\\", "\\"))
def form_fields(spark, d):
    return lines(spark, d).where(F.col("line").rlike(r"^[A-Za-z ]+\|")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim(F.regexp_extract("line", r"^([A-Za-z ]+?) ?\|", 1)).alias("field"))


@query("X14_pairs", r"WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,} [a-z]{3,}'))) p FROM documents) SELECT doc_id, split_part(p, ' ', 1) AS name, split_part(p, ' ', 2) AS position FROM m")
def name_pairs(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,} [a-z]{3,}"), F.lit(0)))).alias("p"))
    return p.select("doc_id", F.split_part("p", F.lit(" "), F.lit(1)).alias("name"), F.split_part("p", F.lit(" "), F.lit(2)).alias("position"))


@query("X15_service_fields", "SELECT event_id, coalesce((props::JSON ->> '$.k')::BIGINT, 0) AS k, coalesce(props::JSON ->> '$.office', event_type) AS office FROM events")
def service_fields(spark, d):
    m = F.from_json("props", "k long, office string")
    return table(spark, d, "events").select("event_id", F.coalesce(m["k"], F.lit(0)).cast("long").alias("k"), F.coalesce(m["office"], F.col("event_type")).alias("office"))


@query("X16_outline", f"WITH {LINES} SELECT source, count(DISTINCT lower(line)) AS names, min(line) AS first FROM lines WHERE regexp_matches(line, '{HEADING}') GROUP BY source")
def outline(spark, d):
    return lines(spark, d).where(F.col("line").rlike(HEADING)).groupBy("source").agg(F.count_distinct(F.lower("line")).alias("names"), F.min("line").alias("first"))


@query("X17_structure", f"WITH {LINES} SELECT doc_id, count(*) AS lines, count_if(regexp_matches(line, '{HEADING}')) AS headings, count_if(contains(line, '|')) AS table_lines, max(length(line))::BIGINT AS widest FROM lines GROUP BY doc_id")
def structure(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(HEADING)).alias("headings"), F.count_if(F.contains("line", F.lit("|"))).alias("table_lines"), F.max(F.length("line")).cast("long").alias("widest"))


@query("X18_items", r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(?:\d+[.)]|[-*]) .+$')) item FROM documents) SELECT doc_id, count(*) AS items FROM m GROUP BY doc_id UNION ALL SELECT -1, 0")
def items(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:\d+[.)]|[-*]) .+$"), F.lit(0))).alias("item"))
    return m.groupBy("doc_id").agg(F.count("*").alias("items")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("items")))


@query("H14_kind", r"SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' ELSE 'prose' END AS kind FROM documents")
def kind(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.contains("text", F.lit("|")), "table").when(F.col("text").rlike("(?i)licen[sc]e"), "license").otherwise("prose").alias("kind"))


__all__ = ["tf"]
