"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pattern packing: patterns of few documents that fill a sequence are enumerated,
non-negative least squares fits how often to repeat each so that together they
use up the histogram of lengths, the counts are rounded down, then up where lengths
are left, and best fit packs the rest. Lengths that the fit leaves get further
patterns among themselves before the next fit. Everything after the histogram works on counts of lengths, of which
there are at most as many as the sequence is long, so the plan's cost does not
grow with the corpus; documents are then dealt into the plan by their rank among
those of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _components as cc
from . import _text as tx
from . import _tokens as tk
from ._repeats import NO_ID, parts

LENGTH = 2048
PARTNERS = 12
STEPS = 1000  # of one fit, at most
CLOSE = 1e-4  # a fit is done when a step lowers its residual by less than this share
FITS = 3
ROUNDED = 0.05  # a fit's remainder from which a pattern may be used once more


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                ids, first = tk.encode(batch.column("text"), path)
                doc, piece, start, size, crc = [], [], [], [], []
                for i in range(len(batch)):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length]
                        doc.append(i)
                        piece.append(k)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["d", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(histogram: np.ndarray, limit: int) -> np.ndarray:
    """Multisets of two to four present lengths that sum to the limit: rows in ascending order, with zeros before."""
    have = histogram > 0
    order = np.flatnonzero(have)
    if not len(order):
        return np.zeros((0, 4), np.int64)
    common = order[np.argsort(-histogram[order], kind="stable")][:PARTNERS]
    partners = np.union1d(common, order[:: max(1, len(order) // PARTNERS)])

    def ending(*parts: np.ndarray) -> np.ndarray:
        """The parts with the length that fills the sequence, where it is present."""
        last = limit - sum(parts)
        ok = (last > 0) & have[np.maximum(last, 0)]
        rows = np.stack([*np.broadcast_arrays(*parts, last)], axis=-1)[ok]
        return np.pad(rows, ((0, 0), (4 - rows.shape[1], 0)))

    b, e = partners[None, :], common[None, None, :]
    found = [ending(order), ending(order[:, None], b), ending(order[:, None, None], b[:, :, None], e)]
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def fitted(histogram: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative x minimising |A x - histogram| for pattern columns A, by multiplicative updates until they gain little; and histogram - A x."""
    if not len(chosen):
        return np.zeros(0), histogram.astype(float)
    which, _ = np.nonzero(chosen)
    item = chosen[chosen > 0]
    target = np.bincount(which, histogram[item].astype(float))
    x = np.full(len(chosen), 1.0)
    made = np.bincount(item, x[which], len(histogram))
    before = np.inf
    for _ in range(STEPS):
        x *= target / np.maximum(np.bincount(which, made[item], len(chosen)), 1e-12)
        made = np.bincount(item, x[which], len(histogram))
        now = float(np.linalg.norm(made - histogram))
        if before - now < CLOSE * now:
            break
        before = now
    return x, histogram - made


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths of one sequence) that use each length exactly as often as the histogram has it."""
    left = np.zeros(limit + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[limit]:
        out.append((int(left[limit]), (limit,)))
        left[limit] = 0
    chosen = patterns(left, limit)
    x, rest = fitted(left, chosen)
    for _ in range(FITS - 1):
        more = np.unique(np.concatenate([chosen, patterns(np.maximum(np.rint(rest), 0).astype(np.int64), limit)]), axis=0)
        if len(more) == len(chosen):
            break
        chosen = more
        x, rest = fitted(left, chosen)

    def take(i: int, most: int) -> None:
        items = tuple(v for v in chosen[i].tolist() if v)
        need = Counter(items)
        times = min(most, *(int(left[size]) // n for size, n in need.items()))
        if times > 0:
            out.append((times, items))
            for size, n in need.items():
                left[size] -= times * n

    whole = np.floor(x).astype(np.int64)
    order = np.argsort(-x, kind="stable")
    for i in order[whole[order] > 0].tolist():
        take(i, int(whole[i]))
    part = x - whole
    order = np.argsort(-part, kind="stable")
    for i in order[part[order] > ROUNDED].tolist():
        take(i, 1)
    return out + _best_fit(left, limit)


def _best_fit(left: np.ndarray, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing on counts: equal bins are held together and split when only some take an item."""
    bins: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, n: int, items: tuple[int, ...]) -> None:
        if not bins[room]:
            bisect.insort(rooms, room)
        bins[room].append([n, items])

    for size in np.flatnonzero(left)[::-1].tolist():
        count = int(left[size])
        while count:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                per = limit // size
                if count // per:
                    put(limit - per * size, count // per, (size,) * per)
                if count % per:
                    put(limit - count % per * size, 1, (size,) * (count % per))
                break
            room = rooms[at]
            n, items = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            used = min(n, count)
            if n > used:
                put(room, n - used, items)
            put(room - size, used, (*items, size))
            count -= used
    return [(n, items) for group in bins.values() for n, items in group]


def runs(chosen: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, items of that length in one sequence, offset; sorted by length and rank."""
    at: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for times, items in chosen:
        offset = 0
        for size in sorted(set(items), reverse=True):
            n = items.count(size)
            out.append((size, at[size], sequence, n, offset))
            at[size] += times * n
            offset += size * n
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _dealt(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            size, rank = (np.asarray(batch.column(x)) for x in ("length", "rank"))
            row = table[np.searchsorted(keys, (size << 48) + rank, side="right") - 1]
            among = rank - row[:, 1]
            columns = [batch.column(x) for x in ("d", "piece", "start", "length", "ids_crc32")]
            columns[0] = pa.compute.if_else(pa.compute.equal(columns[0], NO_ID), None, columns[0])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + among // row[:, 3]), pa.array(row[:, 4] + among % row[:, 3] * size)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Packs every document's ids and one end id into sequences of at most `length` ids.

    Only documents that are longer are cut. Returns one row a piece: doc_id, piece,
    start, length, ids_crc32, sequence_id (from 0), offset. Null and empty texts are
    one end id; null ids stay null; equal rows are packed each for itself; an empty
    table gives no row. Other columns are ignored. `tokenizer` is a path that every
    executor has (a file of an installed package).
    """
    cc.prepare(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = rows.mapInArrow(_pieces(tokenizer, length, end_id), "d long, piece int, start long, length long, ids_crc32 long").withColumn("rid", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(8 * parts(docs)))).checkpoint()
    counts = made.groupBy("length", "salt").count()
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most `length` rows
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")) - 1
    ranked = made.withColumn("rank", rank.cast("long")).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.mapInArrow(_dealt(runs(plan(histogram, length))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
