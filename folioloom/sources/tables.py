"""Readers of the tables, and the domain views laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import text as tf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("office_id"), F.col("n_name").alias("office"), F.col("r_name").alias("service_category"))


OFFICES = "offices AS (SELECT n_nationkey office_id, n_name office, r_name service_category FROM nation JOIN region ON n_regionkey = r_regionkey)"


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    status = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "In Progress").when(F.col("o_orderkey") % 2 == 0, "Resolved").otherwise("Closed")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent").when(F.col("o_orderpriority") == "2-HIGH", "High").when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("Low")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_nationkey").alias("office_id"), F.col("n_name").alias("office"), status.alias("status"), priority.alias("priority"), F.col("o_orderdate").alias("updated_at"))
    )


TICKETS = """tickets AS (SELECT o_orderkey ticket_id, o_custkey user_id, c_name user_name, c_nationkey office_id, n_name office,
 CASE WHEN o_orderstatus = 'O' THEN 'Open' WHEN o_orderstatus = 'P' THEN 'In Progress' WHEN o_orderkey % 2 = 0 THEN 'Resolved' ELSE 'Closed' END status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END priority, o_orderdate updated_at
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


#: A title is the first sentence of the first line that has any.
TITLE = r"^\s*([^\n.!?]*)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(q, "doc_id", "left").select("doc_id", tf.collapse(F.regexp_extract("text", TITLE.replace(r"\s", tf.SPACE), 1)).alias("title"), F.col("lang").alias("category"), F.col("source").alias("subcategory"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("published"), F.col("text").alias("content"))


ARTICLES = rf"articles AS (SELECT doc_id, trim(regexp_replace(regexp_extract(text, '{TITLE}', 1), '\s+', ' ', 'g')) title, lang category, source subcategory, coalesce(quality = 1, false) published, text content FROM documents LEFT JOIN labels USING (doc_id))"


def chunks(spark: SparkSession, sf_dir: str, size: int = 900, overlap: int = 120) -> DataFrame:
    """Fixed windows of each document; blank ones dropped and the rest numbered."""
    d = table(spark, sf_dir, "documents")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(step))
    cut = d.select("doc_id", "lang", "source", F.posexplode(starts).alias("place", "char_start"), "text").withColumn("chunk", tf.strip(F.substr("text", F.col("char_start") + 1, F.lit(size))))
    order = Window.partitionBy("doc_id").orderBy("place")
    return cut.where("chunk <> ''").select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "char_start", "lang", "source", F.col("chunk").alias("text"))


CHUNKS = r"""cut AS (SELECT doc_id, lang, source, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) char_start, text FROM documents),
 cleaned AS (SELECT doc_id, lang, source, char_start, regexp_replace(substring(text, char_start + 1, 900), '^\s+|\s+$', '', 'g') text FROM cut),
 chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 chunk_index, char_start, lang, source, text FROM cleaned WHERE text <> '')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) line_no, unnest(string_split(text, chr(10))) line FROM documents)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn of each conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))


ASKED = "asked AS (SELECT conv_id, arg_min(text, turn) question FROM conversations WHERE role = 'user' GROUP BY conv_id)"
