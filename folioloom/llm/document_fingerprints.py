"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and
the least hash of all, so that short texts have one too. It depends only on the
set of shingles, so the sketch of a union is the merged sketches cut likewise,
and the share of one sketch found in another estimates containment however
unequal the texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._repeats import NO_ID, parts

FRACTION = 0.25
WORDS = 5


def sketches(column: pa.Array, k: int = WORDS, fraction: float = FRACTION) -> list[np.ndarray]:
    """Sorted distinct kept hashes of each text; texts of fewer than k words have one shingle, those of none an empty sketch."""
    data, off = tx.buffers(column)
    start, end, doc = tx.words(data, off)
    value = tx.ranges(tx.prefix(data), start, end)
    first = np.searchsorted(doc, np.arange(len(off)))
    n = np.diff(first)
    found = [tx.grams(value, k)]
    owner = [doc[: len(found[0])]]
    inside = owner[0] == doc[k - 1 :][: len(found[0])] if len(found[0]) else np.zeros(0, bool)
    found[0], owner[0] = found[0][inside], owner[0][inside]
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            found.append(tx.grams(value, size)[first[few]])
            owner.append(few)
    h, d = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    if len(h):
        begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        low = np.repeat(np.minimum.reduceat(h, begin), np.diff(np.append(begin, len(h))))
        keep = (h < np.uint64(min(fraction, 1) * (2**64 - 1024))) | (h == low)
        h, d = h[keep], d[keep]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, d = h[new], d[new]
    return np.split(h, np.searchsorted(d, np.arange(1, len(off) - 1))) if len(off) > 1 else []


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of what two sketches stand for."""
    h = np.union1d(a, b)
    return h[(h < np.uint64(min(fraction, 1) * (2**64 - 1024))) | (h == h[:1])] if len(h) else h


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate; 1 for two empty sketches."""
    both = shared(a, b)
    return both / union if (union := len(a) + len(b) - both) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return shared(a, b) / len(a) if len(a) else 1.0


def _sketch(k: int, fraction: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                found = sketches(batch.column("text"), k, fraction)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_of(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int32())], ["doc_id", "fingerprint", "n_hashes"])

    return run


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """doc_id, fingerprint (hex of the sorted kept hashes, 16 digits each) and n_hashes of every row.

    Null texts count as empty and have an empty fingerprint; equal texts have equal
    ones. Ids may be null or repeated. Other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_sketch(k, fraction), "doc_id long, fingerprint string, n_hashes int")


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_containment double"


def _pairs(ids: list, texts: list[str], after: list[str], known: list[np.ndarray], nexts: list[np.ndarray], k: int, fraction: float) -> pa.RecordBatch:
    """Rows for texts with their successors."""
    edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after, strict=True)]
    changed = sketches(pa.array(edited, pa.large_string()), k, fraction)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([text_of(x) for x in known], pa.string()), "edited_fingerprint": pa.array([text_of(x) for x in changed], pa.string()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(known, changed, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(a, b) for a, b in zip(known, nexts, strict=True)], pa.float64()),
        "edited_containment": pa.array([containment(a, b) for a, b in zip(known, changed, strict=True)], pa.float64()),
    })


def _inner(k: int, fraction: float):
    """Every row of a sorted partition but its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for batch in tx.pieces(whole):
                own = sketches(batch.column("text"), k, fraction)
                rows = held + list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own, strict=True))
                if len(rows) > 1:
                    ids, texts, known = (list(x) for x in zip(*rows, strict=True))
                    yield _pairs(ids[:-1], texts[:-1], texts[1:], known[:-1], known[1:], k, fraction)
                held = rows[-1:]

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first (side 0) and last row (side 1) of a sorted partition."""
    last = None
    for batch in batches:
        if len(batch):
            if last is None:
                yield batch.slice(0, 1).append_column("side", pa.array([0], pa.int32()))
            last = batch.slice(len(batch) - 1, 1)
    if last is not None:
        yield last.append_column("side", pa.array([1], pa.int32()))


def _outer(k: int, fraction: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                texts, after = batch.column("text").to_pylist(), batch.column("after").to_pylist()
                known, nexts = sketches(batch.column("text"), k, fraction), sketches(batch.column("after"), k, fraction)
                yield _pairs(batch.column("doc_id").to_pylist(), texts, after, known, nexts, k, fraction)

    return run


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by
    as many from the start of the next document in id order; the first follows the
    last. Null texts are empty; null ids come first; rows with equal ids are ordered
    by a hash of their text; one row alone is its own successor; an empty table
    gives no row. Other columns are ignored.

    Texts are range-partitioned once. Successors inside a partition are found while
    it streams; only the first and last row of each partition meet in a window.
    """
    n = parts(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(n, "d", "h").sortWithinPartitions("d", "h").select("doc_id", "text")
    inner = ranged.mapInArrow(_inner(k, fraction), _PAIR)
    ends = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_ends, "doc_id long, text string, part int, side int")
    order = Window.orderBy("part", "side")
    outer = ends.withColumn("after", F.coalesce(F.lead("text").over(order), F.first("text").over(order))).where("side = 1")
    return inner.unionByName(outer.select("doc_id", "text", "after").mapInArrow(_outer(k, fraction), _PAIR))


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
SQL: dict[str, str] = {}
