"""Exact search for passages of L tokens that occur more than once.

Tokens are bytes or words. Every window of L tokens picks an anchor: the
rightmost least hash among its k-grams. Equal windows pick equal anchors at
equal places, so windows need only be compared inside the group of one anchor
hash. The windows of one document that pick the same anchor stand side by side;
the text they span is a *fragment*, and no two windows of a fragment are equal.

    texts -> anchors (one row for each seed of a block of text) -> seeds seen twice
          -> fragments round those seeds -> a matcher for each seed -> covered ranges

Texts are shuffled once, by document; that exchange is read again by each later
join. Documents with the same text are folded into one beforehand. Rows of a
frequent seed or fragment are folded inside each block of text before they are
shuffled, so a passage found everywhere costs one row a block; fragments are told
apart by their bytes.

A line that stands in a third of all texts, each time among other words, would
give its seed as many different fragments. Seeds with over `hot` occurrences are
therefore counted beforehand: their fragments are taken apart into windows, each
known by its XXH3 hash of 128 bits and dealt out by that, so only windows that can
be equal meet, and they are compared row by row, without a group in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _components as cc
from . import _text as tx

HOT_SEEDS = 1_000_000  # at most so many are told to the tasks (8 MB); any other has under a millionth of all anchors, or `hot`
SLICE = 1 << 23
_MASK = np.uint64((1 << 24) - 1)


class Tokens:
    """One block of documents as tokens: `data` bytes, token bounds, and where each document's tokens begin."""

    def __init__(self, column: pa.Array, unit: str):
        data, off = tx.buffers(column)
        self.unit = unit
        if unit == "words":
            self.data, self.start, self.end, doc = tx.joined(data, off)
            self.first = np.searchsorted(doc, np.arange(len(off)))
        else:
            self.data, self.start, self.end, self.first = data, None, None, off
        self.size = int(self.first[-1])

    def hashes(self, k: int) -> np.ndarray:
        """Of every run of k tokens; equal runs have equal hashes, and it is no matter if others have too."""
        sums = tx.rough_prefix(self.data)
        if self.unit == "words":
            return tx.grams(tx.rough(sums, self.start, self.end), k)
        at = np.arange(max(0, self.size - k + 1))
        return tx.rough(sums, at, at + k)

    def span(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the tokens lo..hi-1."""
        return (self.start[lo], self.end[hi - 1]) if self.unit == "words" else (lo, hi)


def anchors(t: Tokens, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: document, seed, anchor and first window (tokens of the block), number of windows."""
    h = t.hashes(k)
    found: list[tuple[np.ndarray, ...]] = []
    most = np.maximum(0, np.diff(t.first) - length + 1)
    edge = np.zeros(t.size + 1, np.int32)
    np.add.at(edge, t.first[:-1][most > 0], 1)
    np.add.at(edge, (t.first[:-1] + most)[most > 0], -1)
    valid = np.cumsum(edge[:-1]).astype(bool)
    for at in range(0, max(0, t.size - length + 1), SLICE):
        end = min(at + SLICE, t.size - length + 1)
        part = h[at : end + length - k]
        place = np.arange(len(part), dtype=np.uint64)
        low = tx.least((part & ~_MASK) | (_MASK - place), length - k + 1)
        s = np.flatnonzero(valid[at:end])
        if not len(s):
            continue
        p = (_MASK - (low[s] & _MASK)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1])]))
        found.append((p[new] + at, s[new] + at, np.diff(np.append(new, len(s)))))
    p, lo, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return {"doc": np.searchsorted(t.first, lo, side="right") - 1, "seed": h[p].view(np.int64) if len(p) else p, "p": p, "lo": lo, "n": n}


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Slices of the bytes as a binary column; null where `empty`."""
    size = np.where(empty, 0, end - start)
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    index = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    valid = np.packbits(~empty, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(valid), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[index])])


def _anchors(unit: str, length: int, k: int) -> Callable:
    """Seeds of each block and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                seed, times = np.unique(anchors(Tokens(batch.column("text"), unit), length, k)["seed"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(times, pa.int64())], ["seed", "times"])

    return run


def _seeds(unit: str, length: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                t = Tokens(batch.column("text"), unit)
                a = anchors(t, length, k)
                if not len(a["p"]):
                    continue
                p = (a["p"] - t.first[a["doc"]]).astype(np.int64)
                d, h = tx.key_columns(batch, ["d", "h"], a["doc"])
                # The first of a seed in this block goes to the seed's group; the others are known to be repeated.
                _, first, group, times = np.unique(a["seed"], return_index=True, return_inverse=True, return_counts=True)
                lead = np.zeros(len(p), bool)
                lead[first] = True
                own = tx.mix(np.asarray(h).view(np.uint64) + tx.mix(p.view(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(lead, a["seed"], own)), d, h, pa.array(p.astype(np.int32)), pa.array(np.minimum(times, 2)[group].astype(np.int32))], ["route", "d", "h", "p", "times"])

    return run


def _fragments(unit: str, length: int, k: int, hot: np.ndarray) -> Callable:
    """Fragments round the anchors asked for; those of hot seeds (sorted) as windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                t = Tokens(batch.column("text"), unit)
                a = anchors(t, length, k)
                asked = batch.column("ps").combine_chunks() if isinstance(batch.column("ps"), pa.ChunkedArray) else batch.column("ps")
                flat = np.asarray(asked.flatten(), np.int64)
                owner = np.repeat(np.arange(len(batch)), np.asarray(pa.compute.list_value_length(asked)))
                take = np.zeros(t.size + 1, bool)
                take[t.first[owner] + flat] = True
                a = {x: v[take[a["p"]]] for x, v in a.items()}
                if not len(a["p"]):
                    continue
                d, h = (np.asarray(x) for x in tx.key_columns(batch, ["d", "h"], a["doc"]))
                order = np.lexsort((a["lo"], h, d))
                a, d, h = {x: v[order] for x, v in a.items()}, d[order], h[order]
                start, end = t.span(a["lo"], a["lo"] + a["n"] + length - 1)
                lead, times = _folded(t.data[tx.spread(start, end - start)], end - start)
                split = lead & (hot[np.minimum(np.searchsorted(hot, a["seed"]), len(hot) - 1)] == a["seed"]) if len(hot) else np.zeros(len(lead), bool)
                s = a["lo"] - t.first[a["doc"]]
                keep = lead & ~split
                yield _routed(np.where(keep, a["seed"], _own(h, s)), d, h, s, a["n"], times, fragment=cut(t.data, start, end, ~keep)).filter(pa.array(~split))
                if split.any():
                    yield from _windows(t, {x: v[split] for x, v in a.items()}, d[split], h[split], times[split], length)

    return run


def _folded(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which byte strings are the first of their kind, and how many equal each."""
    _, first, number = tx.distinct(data, size)
    lead = np.zeros(len(size), bool)
    lead[first] = True
    return lead, np.bincount(number)[number] if len(number) else number


def _own(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A group number that nothing else has, but by chance."""
    return tx.mix(h.view(np.uint64) + tx.mix(s.astype(np.uint64) + np.uint64(1))).view(np.int64)


def _routed(route, d, h, s, n, times, fragment=None, twin=None) -> pa.RecordBatch:
    """A row with a fragment is for the matcher, one with a twin is a window, and one with neither repeats what stood earlier in its block."""
    none = lambda kind: pa.nulls(len(route), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(route), none(pa.int64()) if twin is None else pa.array(twin), none(pa.binary()) if fragment is None else fragment, pa.array(d), pa.array(h), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.minimum(times, 2).astype(np.int32))],
        ["route", "twin", "fragment", "d", "h", "s", "n", "times"],
    )


def _windows(t: Tokens, a: dict[str, np.ndarray], d: np.ndarray, h: np.ndarray, whole: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """The windows of fragments, which stand `whole` times in the block: the first of its kind in the block goes to its group, runs of the others are known to be repeated."""
    lo = tx.spread(a["lo"], a["n"])
    owner = np.repeat(np.arange(len(d)), a["n"])
    raw, f = t.data.tobytes(), xxhash.xxh3_128_digest
    start, end = t.span(lo, lo + length)
    names = np.frombuffer(b"".join([f(raw[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]), np.uint8)
    lead, times = _folded(names, np.full(len(lo), 16))
    times = np.maximum(times, whole[owner])
    route, twin = names.view(np.int64).reshape(-1, 2).T
    d, h, s = d[owner], h[owner], lo - t.first[a["doc"]][owner]
    yield _routed(route[lead], d[lead], h[lead], s[lead], np.ones(lead.sum(), np.int64), times[lead], twin=twin[lead])
    again = np.flatnonzero(~lead)
    if len(again):
        new = np.concatenate([[True], (np.diff(again) != 1) | (np.diff(owner[again]) != 0)])
        at = again[new]
        yield _routed(_own(h[at], s[at]), d[at], h[at], s[at], np.diff(np.append(np.flatnonzero(new), len(again))), np.full(len(at), 2))


class Windows:
    """Compares neighbours among windows sorted by hash; `both` counts the first of equal ones too, else only later ones are repeats."""

    def __init__(self, both: bool):
        self.both = both
        self.held: list[np.ndarray] | None = None

    def add(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: route, twin, d, h, s, times. Returns d, h, s of repeats, as rows of three."""
        done = np.zeros(len(rows[0]), bool)
        if self.held is not None:
            rows = [np.append(x, y) for x, y in zip(self.held, rows, strict=True)]
            done = np.append(self.told, done)
        same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        hit = np.append(False, same)
        if self.both:
            hit |= np.append(same, False) | (rows[5] > 1)
        self.held, self.told = [x[-1:] for x in rows], (hit | done)[-1:]
        return np.stack(rows[2:5], axis=1)[hit & ~done]


def _matched(make: Callable, length: int, both: bool) -> Callable:
    """Runs a matcher over rows sorted by route. It is given (seed, fragment, key, windows, times) and yields (key, first token, end token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, windows = make(length), Windows(both)
        for batch in batches:
            fragment, twin = batch.column("fragment").is_valid(), batch.column("twin").is_valid()
            known = batch.filter(pa.compute.invert(pa.compute.or_(fragment, twin)))
            if len(known):
                d, h, s, n = (np.asarray(known.column(x)) for x in "dhsn")
                yield _found(d, h, s, s + n + length - 1)
            some = batch.filter(twin)
            if len(some):
                d, h, s = windows.add([np.asarray(some.column(x)) for x in ("route", "twin", "d", "h", "s", "times")]).T
                yield _found(d, h, s, s + length)
            out: list[tuple] = []
            columns = [batch.filter(fragment).column(x).to_pylist() for x in ("route", "fragment", "d", "h", "s", "n", "times")]
            for route, text, d, h, s, n, times in zip(*columns, strict=True):
                out += matcher.add(route, text, (d, h, s), n, times)
            if out:
                yield _rows(out)
        if out := matcher.close():
            yield _rows(out)

    return run


def _found(d: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["d", "h", "a", "b"])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    d, h, a, b = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["d", "h", "a", "b"])


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


NO_ID = -(1 << 63)


def covered(docs: DataFrame, id_col: str, text_col: str, unit: str, length: int, k: int, make: Callable, both: bool, hot: int, carry: bool = False) -> DataFrame:
    """Every row of docs with its text and the token ranges its matcher found.

    Columns: d (id, NO_ID for null), h, text, copy (0 for the first row of its
    text in id order), copies (rows with this text), spans (array of a, b; null
    if none). Spans are those of the first row of the text. With `carry`, `other`
    is a struct of all columns but the text. `both`: the first of equal windows is
    a repeat too.
    """
    cc.prepare(docs)
    n = parts(docs)
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    other = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("other")] if carry else []
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), text.alias("text"), *other)
    base = base.withColumn("h", F.xxhash64("text"))
    texts = base.repartition(n, "d", "h").withColumn("row", F.row_number().over(Window.partitionBy("d", "h").orderBy("d")))
    ids = base.select("d", "h", F.xxhash64(F.lit(1), "text").alias("g")).groupBy("d", "h", "g").agg(F.count("*").alias("same"))
    groups = ids.groupBy("h", "g").agg(F.min("d").alias("lead"), F.sum("same").alias("copies"))
    flags = cc.join_counted(ids, groups, ["h", "g"], "copies", docs.count()).select("d", "h", "copies", (F.col("d") == F.col("lead")).alias("lead"))
    leads = flags.where("lead").select("d", "h")
    once = texts.where("row = 1").join(leads.hint("merge"), ["d", "h"]).select("d", "h", "text")

    seeds = once.mapInArrow(_seeds(unit, length, k), "route long, d long, h long, p int, times int").repartition(n, "route")
    # a seed has at most one row a block
    often = seeds.withColumn("total", F.sum("times").over(Window.partitionBy("route"))).where("total > 1")
    asked = often.groupBy("d", "h").agg(F.collect_list("p").alias("ps"))
    around = texts.where("row = 1").join(asked.hint("merge"), ["d", "h"]).select("d", "h", "text", "ps")
    counts = base.select("text").mapInArrow(_anchors(unit, length, k), "seed long, times long").groupBy("seed").agg(F.sum("times").alias("times"))
    frequent = counts.where(F.col("times") > hot).orderBy(F.desc("times")).limit(HOT_SEEDS).select("seed").collect()
    fragments = around.mapInArrow(_fragments(unit, length, k, np.array(sorted(r[0] for r in frequent), np.int64)), "route long, twin long, fragment binary, d long, h long, s int, n int, times int")
    found = fragments.repartition(n, "route").sortWithinPartitions("route", "twin", "d", "h", "s").mapInArrow(_matched(make, length, both), "d long, h long, a int, b int")
    spans = found.groupBy("d", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return (
        texts.join(flags.hint("merge"), ["d", "h"])
        .join(spans.hint("merge"), ["d", "h"], "left")
        .select("d", "h", "text", F.when(F.col("lead"), F.col("row") - 1).otherwise(F.lit(1)).alias("copy"), "copies", "spans", *["other"] * carry)
    )


def marks(batch: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Tokens of a block that lie in a span."""
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    spans = batch.column("spans")
    owner = np.repeat(np.arange(len(batch)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0)))
    flat = spans.flatten()
    if len(flat):
        a, b = (np.asarray(x, np.int64) for x in flat.flatten())
        np.add.at(edge, first[owner] + a, 1)
        np.add.at(edge, first[owner] + b, -1)
    return np.cumsum(edge[:-1]) > 0
