"""Suffix-array dedup: removes bytes of long passages that also stand elsewhere.

Fragments of one seed arrive in order and gather into batches. A batch gets a
suffix array (prefix doubling, cut at the match length) and is merge-scanned
against each level of an index family; equal windows are marked on both sides.
Then it joins the family: while a level of its size exists, the two are merged,
so sizes grow geometrically and a window takes part in O(log n) merges. Levels
are dropped once every seed they hold has passed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _repeats as rp
from . import _text as tx

BATCH = 1 << 14
HOT = 4096  # fragments that one seed may bring to one task


def prefix_classes(text: np.ndarray, length: int) -> np.ndarray:
    """A number for each position, ordered and equal as the next `length` bytes are (zeros follow the text)."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    _, rank = np.unique(key, return_inverse=True)
    have = 8
    while have < length:
        step = min(have, length - have)
        later = np.zeros(n, np.uint64)
        later[: max(0, n - step)] = rank[step:] + 1
        _, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | later, return_inverse=True)
        have += step
    return rank


class Level:
    """Texts with the sorted starts of their windows; `hit` marks windows that stand elsewhere too, in the order of `windows`."""

    def __init__(self, text: np.ndarray, windows: np.ndarray, length: int):
        self.length, self.text, self.windows = length, text, windows
        classes = prefix_classes(text, length)[windows]
        order = np.argsort(classes, kind="stable")
        same = classes[order][1:] == classes[order][:-1]
        hit = np.zeros(len(windows), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        self.array, self.hit = order, hit
        self.notes: list = []
        self._wide()

    def _wide(self) -> None:
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.wide = np.zeros(len(self.text), np.uint64)
        for i in range(8):
            self.wide = (self.wide << np.uint64(8)) | padded[i : i + len(self.text)]

    def compare(self, mine: np.ndarray, other: Level, its: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows starting at `mine` here against those starting at `its` there."""
        out = np.zeros(len(mine), np.int8)
        live = np.arange(len(mine))
        for at in [*range(0, self.length - 7, 8), max(0, self.length - 8)]:
            a, b = self.wide[mine[live] + at], other.wide[its[live] + at]
            off = a != b
            out[live[off]] = np.where(a[off] < b[off], -1, 1)
            live = live[~off]
            if not len(live):
                break
        return out

    def scan(self, other: Level) -> np.ndarray:
        """Marks windows that both hold; returns where each sorted window of `other` belongs in this array."""
        mine, its = self.windows[self.array], other.windows[other.array]
        low, high = np.zeros(len(its), np.int64), np.full(len(its), len(mine))
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            less = self.compare(mine[middle], other, its[live]) < 0
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
        inside = np.flatnonzero(low < len(mine))
        same = inside[self.compare(mine[low[inside]], other, its[inside]) == 0]
        other.hit[other.array[same]] = True
        # every window here that equals one of the other's: the run that starts at `low`
        starts = np.unique(low[same])
        if len(starts):
            here = np.zeros(len(mine), bool)
            here[starts] = True
            while True:
                next_ = starts + 1
                next_ = next_[next_ < len(mine)]
                same_run = self.compare(mine[next_], self, mine[next_ - 1]) == 0
                starts = next_[same_run]
                if not len(starts):
                    break
                here[starts] = True
            self.hit[self.array[here]] = True
        return low

    def merged(self, other: Level, place: np.ndarray) -> Level:
        """One level of both; the sorted orders are merged, not sorted anew."""
        out = object.__new__(type(self))
        out.length = self.length
        out.text = np.concatenate([self.text, other.text])
        out.windows = np.concatenate([self.windows, other.windows + len(self.text)])
        out.array = np.insert(self.array, place, other.array + len(self.windows))
        out.hit = np.concatenate([self.hit, other.hit])
        out.wide = np.concatenate([self.wide, other.wide])
        out.notes = self.notes + [(key, n, at + len(self.windows)) for key, n, at in other.notes]
        return out

    def spans(self) -> list[tuple]:
        """Covered byte ranges of each fragment."""
        out = []
        for (d, h, s), n, at in self.notes:
            hit = np.concatenate([[0], self.hit[at : at + n].astype(np.int8), [0]])
            turn = np.diff(hit)
            out += [(d, h, s + int(a), s + int(b) - 1 + self.length) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
        return out


class Family:
    """The matcher of one task."""

    def __init__(self, length: int, level: type[Level] = Level):
        self.length, self.level = length, level
        self.levels: list[Level] = []
        self.route = None
        self.seen: dict[bytes, int] = {}
        self.own: list[list] = []  # distinct fragments of the seed: key, windows, fragment, repeated whole
        self.fresh: list[list] = []  # those of earlier seeds and this one that wait for a batch
        self.waiting = 0

    def add(self, route: int, fragment: bytes, key: tuple, n: int, times: int) -> list[tuple]:
        out: list[tuple] = []
        if route != self.route:
            out = self._next()
            self.route = route
        d, h, s = key
        if (at := self.seen.get(fragment)) is not None:
            self.own[at][3] = True
            return [*out, (d, h, s, s + n + self.length - 1)]
        self.seen[fragment] = len(self.own)
        self.own.append([key, n, fragment, times > 1])
        if len(self.own) > 1:
            for x in self.own[-1:] if len(self.own) > 2 else self.own:
                self.fresh.append(x)
                self.waiting += len(x[2])
        if self.waiting >= BATCH:
            self._insert()
        return out

    def _insert(self) -> None:
        if not self.fresh:
            return
        text = np.frombuffer(b"".join(x[2] for x in self.fresh), np.uint8)
        size = np.array([len(x[2]) for x in self.fresh])
        count = np.array([x[1] for x in self.fresh])
        begin = np.cumsum(size) - size
        at = np.cumsum(count) - count
        windows = np.repeat(begin - at, count) + np.arange(count.sum())
        new = self.level(text, windows, self.length)
        new.notes = [(x[0], x[1], int(y)) for x, y in zip(self.fresh, at, strict=True)]
        self.fresh, self.waiting = [], 0
        places = [level.scan(new) for level in self.levels]
        while self.levels and len(self.levels[-1].text) < 2 * len(new.text):
            last = self.levels.pop()
            place = places.pop() if places else last.scan(new)
            new = last.merged(new, place)
            places = []
        self.levels.append(new)

    def _next(self) -> list[tuple]:
        """The seed has passed: whole repeats are known, and a full batch or family can close."""
        out = [(key[0], key[1], key[2], key[2] + n + self.length - 1) for key, n, _, whole in self.own if whole]
        self.own, self.seen = [], {}
        if self.levels or self.waiting >= BATCH // 2:
            self._insert()
            out += [x for level in self.levels for x in level.spans()]
            self.levels = []
        return out

    def close(self) -> list[tuple]:
        out = self._next()
        self._insert()
        out += [x for level in self.levels for x in level.spans()]
        self.levels = []
        return out


def _kept(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                data, off = tx.buffers(batch.column("text"))
                gone = rp.marks(batch, off)
                copies = np.asarray(batch.column("copies"))
                n = np.diff(off)
                removed, spans, digest, kept = [], [], [], []
                for i in range(len(batch)):
                    part, mark = data[off[i] : off[i + 1]], gone[off[i] : off[i + 1]]
                    if copies[i] > 1:
                        mark = np.full(len(part), n[i] >= length)
                    rest = part[~mark].tobytes()
                    removed.append(int(mark.sum()))
                    spans.append(int((mark[1:] & ~mark[:-1]).sum() + mark[:1].sum()))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    if with_text:
                        kept.append(rest)
                ids = pa.compute.if_else(pa.compute.equal(batch.column("d"), rp.NO_ID), None, batch.column("d"))
                out = {"doc_id": ids, "n_bytes": pa.array(n), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return run


def covered(docs: DataFrame, family: Callable, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 32, hot: int = HOT) -> DataFrame:
    """Rows of docs with the byte ranges that stand elsewhere too, found by a family in each task."""
    return rp.covered(docs, id_col, text_col, "bytes", length, k, family, True, hot)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 32, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Removes each byte covered by a `length`-byte string that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes
    left, which need not be valid UTF-8; only if with_text), one row for each input row. Null and
    empty texts have no bytes; a null id stays null; rows that are equal count as
    copies of each other, so texts of `length` bytes or more with a copy go whole.
    Other columns are ignored, so their names cannot clash.
    """
    rows = covered(docs, Family, id_col, text_col, length, k, hot)
    return rows.select("d", "text", "copies", "spans").mapInArrow(_kept(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_array_dedup(docs, with_text=False)


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
SQL: dict[str, str] = {}
