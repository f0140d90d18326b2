"""Exact cosine top-k of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 4096  # vectors of a block, on both sides
SCORES = 1 << 20  # scores that a task holds at once


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, labels and unit vectors, as bytes; one row a block and dimension."""
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            batch = whole.slice(at, ROWS)
            ids, labels = np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("label"), np.int64)
            size = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for dim in np.unique(size).tolist():
                own = size == dim
                x = np.asarray(batch.column("embedding").filter(pa.array(own)).flatten(), np.float64).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([labels[own].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "labels", "x"])


def blocks(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_packed, "dim int, ids binary, labels binary, x binary")


def _leading(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest scores of each row, of equals those with smaller ids; only scores that reach the k-th greatest are sorted."""
    if k >= score.shape[1]:
        row, column = (x.ravel() for x in np.indices(score.shape))
    else:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        row, column = np.nonzero(score >= least)
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _best(k: int):
    """The k best vectors of a block for each query of a block; queries of a block are asked a few at a time, so that a task never holds more than SCORES scores, or those of one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, asked_dims, given = batch.column("dim").to_pylist(), batch.column("asked_dim").to_pylist(), [batch.column(c) for c in ("asked", "q", "ids", "labels", "x")]
            for at, dim in enumerate(dims):
                if dim != asked_dims[at]:
                    continue
                asked, q, ids, labels, x = (np.frombuffer(column[at].as_buffer(), t) for column, t in zip(given, (np.int64, np.float64, np.int64, np.int64, np.float64)))
                q, x = q.reshape(-1, dim), x.reshape(-1, dim)
                step = max(1, SCORES // len(x))
                for first in range(0, len(q), step):
                    score = q[first : first + step] @ x.T
                    np.maximum(0.0, score, out=score)
                    score *= 1e4
                    score += 0.5
                    np.floor(score, out=score)
                    score /= 1e4
                    row, column = _leading(score, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[first + row]), pa.array(ids[column]), pa.array(labels[column]), pa.array(score[row, column])], ["query_id", "vec_id", "label", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of greatest cosine for each query: query_id, vec_id, label, score (4 places, not below 0), rank.

    Both sides are packed into blocks of at most ROWS vectors; each pair of blocks
    is one row and one product of matrices, which leaves k rows a query. Ties go to
    the smaller id. Vectors meet only those of their own dimension.
    """
    q = blocks(queries).select(F.col("dim").alias("asked_dim"), F.col("ids").alias("asked"), F.col("x").alias("q"))
    pairs = blocks(vectors).crossJoin(q)
    scored = pairs.mapInArrow(_best(k), "query_id long, vec_id long, label long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
