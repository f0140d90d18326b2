"""Toxicity: significant passages by maximum-scoring segments over token log-odds.

Token scores are log-odds between toxic and other labelled texts over how many texts use
a token, with a Dirichlet prior; tokens whose log-odds are not clearly apart from 0
cost a little, so scores drift down through ordinary text. One linear scan finds
every maximal-scoring segment. Segment scores are calibrated by the extreme-value
law of such maxima (lambda from the token distribution of ordinary text, K from the
maxima of ordinary training texts); the excess of all significant segments over
what a text of that length yields by chance is mapped to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _components as cc
from . import _text as tx

SAMPLE = 10_000  # labelled training texts of each class, at most
Z = 3.0
DRIFT = -0.1
TOP = 6.0
ODDS = 1.5
MARGIN = 3.0  # a segment counts if chance yields one like it in under exp(-MARGIN) texts
CAP = 12.0  # more than this adds no certainty

_INK = np.zeros(256, bool)
_INK[97:123] = _INK[65:91] = _INK[128:] = True


PREFIXES = (4, 5, 6, 7, 8)


def tokens(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Letter runs of each text, lower-cased in A-Z, and where each text's begin.

    A run has several keys, the weakest first: its first 4 to 8 bytes where it is
    longer (else 0), then the whole run. Inflected and compound forms so share what
    is learnt of their stem.
    """
    data, off = tx.buffers(column)
    data = np.where(_INK[data], tx.lower(data), np.uint8(32))
    start, end, doc = tx.words(data, off)
    sums = tx.prefix(data)
    keys = []
    for size in PREFIXES:
        longer = end - start > size
        key = tx.mix(tx.ranges(sums, start, np.where(longer, start + size, end)) + np.uint64(size))
        keys.append(np.where(longer, key, np.uint64(0)))
    return [*keys, tx.ranges(sums, start, end)], np.searchsorted(doc, np.arange(len(off)))


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda
    k: float = 0.1
    slope: float = 1.0
    level: float = -3.0

    def of(self, keys: list[np.ndarray]) -> np.ndarray:
        """Each token's score: that of its longest key that has one."""
        out = np.full(len(keys[-1]), DRIFT)
        for key in keys if len(self.keys) else []:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[hit] = self.scores[at[hit]]
        return out

    def bar(self, n: np.ndarray) -> np.ndarray:
        """What lambda * score must exceed in texts of n tokens."""
        return np.log(np.maximum(self.k * n, 1)) + MARGIN

    def chance(self, excess: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.level + self.slope * excess, -30, 30)))


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) in one linear scan; runs of negative tokens count as one step.

    Each candidate keeps which earlier one is the last to begin at a lower sum, so
    the search for that one jumps over candidates that were passed before.
    """
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    total = np.add.reduceat(score, edge)
    ends = np.append(edge[1:], len(score))
    out: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum behind, candidate that begins lower
    run = 0.0
    for first, end, add, rising in zip(edge.tolist(), ends.tolist(), total.tolist(), up[edge].tolist(), strict=True):
        if not rising:
            run += add
            continue
        left, run = run, run + add
        j = len(out) - 1
        while j >= 0 and out[j][2] >= left:
            j = out[j][4]
        while j >= 0 and out[j][3] < run:  # joined to that one, and to whatever this one then joins
            first, _, left, _, before = out[j]
            del out[j:]
            j = before
        out.append((first, end, left, run, j))
    return [(a, b, right - left) for a, b, left, right, _ in out]


def scan(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Token count, greatest segment score and segments of each text."""
    key, first = tokens(column)
    score = model.of(key)
    n = np.diff(first)
    some = np.add.reduceat(np.append(score > 0, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
    found = [segments(score[first[i] : first[i + 1]]) if some[i] else [] for i in range(len(n))]
    return n, np.array([max((s for _, _, s in x), default=0.0) for x in found]), found


def excess(model: Model, n: np.ndarray, found: list[list[tuple[int, int, float]]]) -> np.ndarray:
    """Sum over significant segments of how far each lies above its chance level in a text of n tokens."""
    return np.array([sum(max(0.0, model.rate * s - b) for _, _, s in x) for x, b in zip(found, model.bar(n).tolist(), strict=True)])


def fold(id_col: str, folds: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % folds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of a block with the number of toxic and of other texts that hold them, and of uses in other texts."""
    for whole in batches:
        for batch in tx.pieces(whole):
            every, first = tokens(batch.column("text"))
            toxic = np.asarray(batch.column("toxic")).astype(np.int64)
            doc = np.tile(np.repeat(np.arange(len(batch)), np.diff(first)), len(every))
            key = np.concatenate(every)
            key, doc = key[key != 0], doc[key != 0]
            keys, back = np.unique(key, return_inverse=True)
            uses = np.bincount(back, 1 - toxic[doc], len(keys)).astype(np.int64)
            order = np.lexsort((doc, back))
            b, d = back[order], doc[order]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (d[1:] != d[:-1])]) if len(b) else np.zeros(0, bool)
            b, d = b[new], d[new]
            t = np.bincount(b, toxic[d], len(keys)).astype(np.int64)
            o = np.bincount(b, 1 - toxic[d], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(t), pa.array(o), pa.array(uses)], ["key", "t", "o", "uses"])


def _maxima(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                n, top, found = scan(model, batch.column("text"))
                packed = [[s for _, _, s in x] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(top), batch.column("toxic"), pa.array(packed, pa.list_(pa.float64()))], ["n", "top", "toxic", "scores"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from rows whose fold is not 1.

    Of each class the `sample` labelled ids with the least hash are taken: a bounded
    set, so it can be broadcast and only its texts are shuffled; of rows with one id
    the text with the least hash counts.
    """
    cc.prepare(docs)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for value in (0, 1):
        own = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic").checkpoint()
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    model = Model()
    if len(size) < 2:
        return model
    counts = texts.mapInArrow(_counted, "key long, t long, o long, uses long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("t", "o", "uses")))
    total = counts.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    # Dirichlet prior: half a text for each token and class, and a little more for tokens that are common overall
    texts_all = size[0] + size[1]
    a = lambda n: 0.5 + (F.col("t") + F.col("o")) * (n * 0.01 / texts_all)
    odds = lambda y, n: F.log((F.col(y) + a(n)) / (F.lit(n + 1) - F.col(y)))
    rated = counts.withColumn("d", odds("t", size[1]) - odds("o", size[0])).withColumn("z", F.col("d") / F.sqrt(1 / (F.col("t") + a(size[1])) + 1 / (F.col("o") + a(size[0]))))
    # ordinary text has the token with this probability; needed for lambda
    rated = rated.withColumn("p", (F.col("uses") + 0.5) / (total + 1))
    rows = rated.where((F.abs("z") >= Z) & (F.abs("d") >= ODDS)).select("key", "d", "p").collect()  # tokens of the bounded sample
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    model.keys = keys[order]
    model.scores = np.clip(np.array([r["d"] for r in rows])[order], -TOP, TOP)
    if not (model.scores > 0).any():
        return model
    p = np.array([r["p"] for r in rows])[order]
    s, w = np.append(model.scores, DRIFT), np.append(p, max(0.0, 1 - p.sum()))
    low, high = 1e-6, 20.0
    if w @ s < 0:
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if w @ np.exp(middle * s) < 1 else (low, middle)
        model.rate = low
    seen = texts.mapInArrow(_maxima(model), "n long, top double, toxic int, scores array<double>").collect()  # at most 2 * sample rows
    n = np.array([r["n"] for r in seen])
    top = np.array([r["top"] for r in seen])
    toxic = np.array([r["toxic"] for r in seen])
    plain = toxic == 0
    model.k = float(np.clip(1 / np.mean(np.maximum(n[plain], 1) * np.exp(-model.rate * top[plain])), 1e-6, 10)) if plain.any() else 0.1
    x = excess(model, n, [[(0, 0, s) for s in r["scores"]] for r in seen])
    share = np.where(toxic == 1, shares.get(1, 1) / max(1, toxic.sum()), shares.get(0, 1) / max(1, plain.sum()))
    share = share / share.mean()
    x = np.minimum(x, CAP)
    a0, b0 = -2.0, 0.5
    for _ in range(60):  # logistic fit by Newton steps with a slight ridge
        q = 1 / (1 + np.exp(-np.clip(a0 + b0 * x, -30, 30)))
        g = np.array([np.sum(share * (q - toxic)), np.sum(share * (q - toxic) * x) + 0.01 * b0])
        v = share * q * (1 - q) + 1e-9
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a0, b0 = a0 - np.clip(step[0], -1, 1), max(1e-3, b0 - np.clip(step[1], -0.5, 0.5))
    model.level, model.slope = float(a0), float(b0)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for whole in batches:
            for batch in tx.pieces(whole):
                n, _, found = scan(model, batch.column("text"))
                p = model.chance(np.minimum(excess(model, n, found), CAP))
                base = model.bar(n).tolist()
                passages = [[{"first": a, "end": b, "score": s} for a, b, s in x if model.rate * s > low] for x, low in zip(found, base, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array(passages, kind)], ["doc_id", "held_out", "score", "predicted", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and passages (token bounds and score of significant segments) of each row.

    Null and empty texts have no passages and the lowest score; null ids are scored,
    never learnt from; repeated rows are scored each for itself; a repeated label is
    toxic if any is. Without labels of both classes all scores are low. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = learn(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    return rows.withColumn("held_out", fold("doc_id") == 1).mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first: int, end: int, score: double>>")


def _clean(model: Model, text_col: str, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole, text_col):
                n, _, found = scan(model, batch.column(text_col))
                yield batch.filter(pa.array(model.chance(np.minimum(excess(model, n, found), CAP)) < limit))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the limit."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = learn(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    return docs.mapInArrow(_clean(model, text_col, limit), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("passages")


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
