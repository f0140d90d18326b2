"""A chunk store kept as Parquet partitioned by document, and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, document_id long, chunk_index long, char_start long, text string, metadata map<string,string>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their kind by extension; unknown ones are errors."""
    kind = F.when(F.lower("path").rlike(r"\.pdf$"), "pdf").when(F.lower("path").rlike(r"\.(png|jpe?g)$"), "image").otherwise("error")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("kind", kind)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as stored rows: id document::index, scalars as a string map."""
    return chunks.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), "text",
        F.create_map(F.lit("doc_lang"), "lang", F.lit("doc_source"), "source").alias("metadata"),
    )


def append(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds rows. Folders are hash buckets of the document: one a document would be millions."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets))).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).drop("bucket")


def point(spark: SparkSession, path: str, chunk_id: str, buckets: int = 64) -> DataFrame:
    """One chunk; its bucket is known, so one folder is read."""
    document = F.lit(int(chunk_id.split("::")[0])).cast("long")
    return spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(document), F.lit(buckets))) & (F.col("chunk_id") == chunk_id)).drop("bucket")


def without_documents(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of all other documents; ids: document_id."""
    return rows.join(ids, "document_id", "left_anti")


def without_file(rows: DataFrame, name: str) -> DataFrame:
    """Drops an exact file name; if none is there, one equal but for case and kind of dash."""
    key = lambda c: F.translate(F.lower(c), "‐‑‒–—", "-----")
    exact = rows.where(F.col("file") == name)
    loose = rows.join(F.broadcast(exact.limit(1).select(F.lit(1).alias("_"))), how="left_anti").where(key(F.col("file")) == key(F.lit(name)))
    gone = exact.unionByName(loose).select("chunk_id").distinct()
    return rows.join(gone, "chunk_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
