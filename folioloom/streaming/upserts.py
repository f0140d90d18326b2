"""A keyed table kept by a stream: every micro-batch writes its own folder, so a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _newest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of each key with the greatest version (unique in a key), combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), version).alias("_x")).select("_x.*")


def write_batch(rows: DataFrame, number: int, path: str, key: str, version: Column) -> None:
    """Replaces the folder of batch `number`; rows with a null key or version are dropped."""
    _newest(rows.where(F.col(key).isNotNull() & version.isNotNull()), key, version).write.mode("overwrite").parquet(f"{path}/log/batch={number:012d}")


def start(rows: DataFrame, path: str, key: str, version: Column, checkpoint: str) -> StreamingQuery:
    """Keeps the table at `path` up to date with a stream."""
    return rows.writeStream.foreachBatch(lambda df, number: write_batch(df, number, path, key, version)).option("checkpointLocation", checkpoint).start()


def _folders(spark: SparkSession, path: str, mark: str) -> dict[int, str]:
    """Whole folders by number; one without its success mark was never finished and is left out."""
    jvm, root = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}=*/_SUCCESS"))
    names = [str(f.getPath().getParent()) for f in found or []]
    return {int(n.rsplit("=", 1)[1]): n for n in names}


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Folders to be read: the newest base and the batches since; and the number of the last batch in them."""
    bases, batches = _folders(spark, path, "base"), _folders(spark, f"{path}/log", "batch")
    base = max(bases, default=-1)
    return [bases[b] for b in bases if b == base] + [batches[n] for n in sorted(batches) if n > base], max([base, *batches])


def latest(spark: SparkSession, path: str, key: str, version: Column) -> DataFrame | None:
    """The table: the newest row of each key. None before the first batch. Folders are listed on the driver, one path a batch since the last base."""
    parts, _ = _parts(spark, path)
    return _newest(spark.read.parquet(*parts), key, version) if parts else None


def compact(spark: SparkSession, path: str, key: str, version: Column) -> None:
    """Writes a base out of all batches so far. Readers use it once it is whole; older folders stay until someone drops them."""
    table, (_, last) = latest(spark, path, key, version), _parts(spark, path)
    if table is not None and last not in _folders(spark, path, "base"):
        table.write.mode("overwrite").parquet(f"{path}/base={last:012d}")
