"""Periodic runs of words by the Lyndon arrays of an order and of its reverse, after Ellert and Fischer.

A run is a stretch of symbols with least period p, at least two periods long, that
cannot be extended. Its root's Lyndon rotation at some place i is the longest Lyndon
word that begins there in one of the two orders, so the next smaller suffix of i
begins at i + p. So it is enough to compare the suffixes at i and at the next smaller
suffix of i, for all i and both orders, and to extend what matches to the left.

Symbols are only compared, never hashed; words become numbers by sorting them. The
next smaller suffixes of all places of a block are first sought side by side: whoever
has not found its own takes over the candidate of its candidate, since all suffixes
between are greater. Places still without it after a number of steps that grows with the block are settled from right
to left, following what is settled, so each place is passed over once. Two suffixes are compared symbol by symbol for a few symbols; what still
matches then is a matched extension, kept by distance: any two places at that distance
inside it end at the same mismatch, so no stretch is matched twice at one distance.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text as tx

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
TURNS = 24  # rounds in which all places look on at once; beyond that, while there are
SIDE_BY_SIDE = 6  # times as many steps as places; those left go one after another
ROUND = 200  # steps that a round costs by itself
STEPS = 8  # symbols that are compared side by side before extensions are kept
BLOCK = 1 << 21  # bytes of text looked at together; one longer text is a block


class Extensions:
    """Longest common extensions of suffixes of one string, reusing what was matched before at the same distance.

    The string ends each text with a symbol that no other place has, so no extension leaves its text.
    """

    def __init__(self, w: np.ndarray):
        self.w = w
        self.known: dict[int, tuple[list[int], list[int]]] = {}  # distance -> where matched stretches begin, and the mismatch that ends each

    def _mismatch(self, i: int, p: int) -> int:
        """The first x >= i with w[x] != w[x + p], by steps that double."""
        w, step = self.w, 16
        while True:
            end = min(i + step, len(w) - p)
            different = w[i:end] != w[i + p : end + p]
            at = int(different.argmax()) if len(different) else 0
            if len(different) and different[at]:
                return i + at
            i, step = end, step * 2

    def _ends(self, p: int, places: np.ndarray) -> np.ndarray:
        """The mismatch behind each of the ascending places, which match at distance p for the first STEPS symbols."""
        begins, ends = self.known.setdefault(p, ([], []))
        out = np.empty(len(places), np.int64)
        at = 0
        while at < len(places):
            i = int(places[at])
            end = self._end(begins, ends, i, p)
            upto = at + int(np.searchsorted(places[at:], end))
            out[at:upto] = end
            at = upto
        return out

    def _end(self, begins: list[int], ends: list[int], i: int, p: int) -> int:
        k = bisect_right(begins, i) - 1
        if k >= 0 and ends[k] > i:
            return ends[k]
        end, k = self._mismatch(i + STEPS, p), k + 1
        if k < len(begins) and begins[k] <= end:  # runs into a stretch already matched: one stretch now
            begins[k] = i
        else:
            begins.insert(k, i)
            ends.insert(k, end)
        return end

    def common_of(self, i: int, j: int) -> int:
        """`common` of one pair."""
        different = self.w[i : i + STEPS] != self.w[j : j + STEPS] if j + STEPS <= len(self.w) else np.append(self.w[i : i + len(self.w) - j] != self.w[j:], True)
        at = int(different.argmax())
        return at if different[at] else self._end(*self.known.setdefault(j - i, ([], [])), i, j - i) - i

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j (i < j, in one text)."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(self.w[i] == self.w[j])
        for _ in range(STEPS - 1):
            if not len(live):
                return out
            out[live] += 1
            live = live[self.w[i[live] + out[live]] == self.w[j[live] + out[live]]]
        if not len(live):
            return out
        p = j[live] - i[live]
        order = np.lexsort((i[live], p))
        live, p = live[order], p[order]
        edges = np.flatnonzero(np.diff(p, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            places = i[live[a:b]]
            out[live[a:b]] = self._ends(int(p[a]), places) - places
        return out

    def before(self, i: int, p: int) -> int:
        """How many symbols before i match those before i + p."""
        w, step, at = self.w, 16, i
        while at > 0:
            begin = max(0, at - step)
            different = np.flatnonzero(w[begin:at] != w[begin + p : at + p])
            if len(different):
                return i - (begin + int(different[-1]) + 1)
            at, step = begin, step * 2
        return i


def lyndon_edges(text: Extensions, w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the next smaller suffix of each place begins, and how much of both is common, for all that have some in common.

    w: the symbols in the order that counts; the last symbol of each text, at `ends`, is less than any other.
    """
    n = len(w)
    after = np.arange(1, n + 1)
    common = np.zeros(n, np.int64)
    live = np.ones(n, bool)
    live[ends] = False  # an end is below all: nothing behind it is asked for
    live = np.flatnonzero(live)
    spent = turns = 0
    while len(live) and (turns < TURNS or spent < SIDE_BY_SIDE * n):
        turns, spent = turns + 1, spent + len(live) + ROUND
        j = after[live]
        a, b = w[live], w[j]
        greater = b > a  # the candidate's suffix is greater: go on
        equal = np.flatnonzero(a == b)
        if len(equal):
            i, k = live[equal], j[equal]
            length = text.common(i, k)
            common[i] = length
            greater[equal] = w[k + length] > w[i + length]
        live = live[greater]
        common[live] = 0
        after[live] = after[after[live]]
    cuts = np.flatnonzero(np.diff(np.searchsorted(ends, live), prepend=-1, append=len(ends)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        _in_turn(text, w, after, common, live[a:b], int(ends[np.searchsorted(ends, live[a])]))
    i = np.flatnonzero(common)
    return i, after[i], common[i]


def _in_turn(text: Extensions, w: np.ndarray, after: np.ndarray, common: np.ndarray, live: np.ndarray, end: int) -> None:
    """Settles the places of one text that are left, from right to left; each step passes over a place for good."""
    base = int(live[0])
    symbol, smaller = w[base : end + 1].tolist(), (after[base : end + 1] - base).tolist()
    for i in (live[::-1] - base).tolist():
        j, length = i + 1, 0
        while True:
            a, b, length = symbol[i], symbol[j], 0
            if a == b:
                length = text.common_of(i + base, j + base)
                a, b = symbol[i + length], symbol[j + length]
            if b < a:
                break
            j = smaller[j]
        smaller[i] = j
        after[i + base], common[i + base] = j + base, length




def runs(w: np.ndarray, ends: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `times` (3 or more) periods and `least` symbols, by start, then period.

    w: numbers from 0, any order, several texts one behind another, each ended by a place listed in `ends`, whose number does not matter.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    w = w.astype(np.int64)
    top = int(w.max(initial=0)) + 1
    text = np.array(w)
    text[ends] = top + np.arange(len(ends))  # of which no two are equal
    shared = Extensions(text)
    found = []
    for order in (w, top - 1 - w):
        order = np.array(order)
        order[ends] = -1
        i, j, common = lyndon_edges(shared, order, ends)
        p = j - i
        # a run's first root begins in its first period, so it matches over the rest of the others
        good = np.flatnonzero(common > (times - 2) * p)
        i, p, stop = i[good], p[good], i[good] + common[good]
        first = np.lexsort((i, stop, p))
        i, p, stop = i[first], p[first], stop[first]
        new = np.ones(len(i), bool)
        new[1:] = (p[1:] != p[:-1]) | (stop[1:] != stop[:-1])
        for a, q, e in zip(i[new].tolist(), p[new].tolist(), stop[new].tolist(), strict=True):
            start = a - shared.before(a, q)
            length = e + q - start
            if length >= max(least, times * q):
                found.append((start, length, q))
    return np.array(sorted(set(found)), np.int64).reshape(-1, 3)


def _best(found: list[list[int]]) -> list[int]:
    """Greatest exact length / period; ties: least start, then period."""
    best = found[0]
    for x in found[1:]:
        if x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


def collapsed(text: pa.Array, tail: list[int | None] | None = None) -> Iterator[tuple[list[list[int]], bytes]]:
    """Runs (start, length, period) of each text's words, and its words joined by one space without those a run repeats.

    tail: for each text a number h or None; with h % 10 = 0 the words from a = h // 10 % n on are replaced by
    repeats of the p = 1 + (n - a) // (3 + h // 10 % 8) words at a.
    """
    data, off = tx.buffers(text)
    start, end, doc = tx.words(data, off)
    first = np.searchsorted(doc, np.arange(len(off)))
    source = np.arange(len(start))
    for d, h in enumerate(tail or []):
        n = int(first[d + 1] - first[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[d] + a : first[d + 1]] = first[d] + a + np.arange(n - a) % p
    size = end - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    every = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[~tx._SPACE[data]]))])
    number = pc.rank(every, tiebreaker="dense").to_numpy().astype(np.int64) if len(start) else np.zeros(0, np.int64)
    # one place more behind each text
    ends = first[1:] + np.arange(len(off) - 1)
    w = np.zeros(len(start) + len(off) - 1, np.int64)
    place = np.arange(len(start)) + doc
    w[place] = number[source]
    found = runs(w, ends)
    whose = np.searchsorted(ends, found[:, 0])
    cut = np.zeros(len(w) + 1, np.int64)
    np.add.at(cut, found[:, 0] + found[:, 2], 1)
    np.add.at(cut, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(cut)[place] == 0)
    long = size[source[kept]] + 1
    bytes_at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(long, out=bytes_at[1:])
    out = np.full(bytes_at[-1], 32, np.uint8)
    ink = np.ones(len(out), bool)
    ink[bytes_at[1:] - 1] = False
    out[ink] = data[tx.spread(start[source[kept]], size[source[kept]])]
    bounds = bytes_at[np.searchsorted(doc[kept], np.arange(len(off)))]
    found[:, 0] -= (first[:-1] + np.arange(len(off) - 1))[whose]
    of = np.searchsorted(whose, np.arange(len(off)))
    for d in range(len(off) - 1):
        yield found[of[d] : of[d + 1]].tolist(), out[bounds[d] : max(bounds[d], bounds[d + 1] - 1)].tobytes()


_ROW = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.pieces(whole, "text", BLOCK):
            ids = batch.column("doc_id").to_pylist()
            tail = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
            out = []
            for i, (found, text) in zip(ids, collapsed(batch.column("text"), tail), strict=True):
                told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                s, n, p = _best(found) if found else (None, None, None)
                out.append((i, len(found), s, n, p, 1000 * n // p if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]], [c.split()[0] for c in _ROW.split(", ")])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for whole in batches:
        for batch in tx.pieces(whole, "text", BLOCK):
            both = list(collapsed(batch.column("text")))
            told = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found, _ in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, kind), pa.array([t.decode() for _, t in both], pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period in words) and collapsed (the text without what runs repeat) of every row.

    Runs have at least 6 words and 4 periods. Null and empty texts have no runs and
    collapse to the empty text; null ids stay null; repeated rows are rows of their own;
    an empty table gives no row; other columns are ignored. A text of any length is one
    block of one task, which holds some 150 bytes for each of its words. No shuffle.
    """
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(_found, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of `periodic_runs`, after every tenth document (by CRC-32 of its id) was given a periodic tail.

    Edge cases as there; a document without id gets no tail. Of runs with equal
    exponents the first is told, of those the one with the least period.
    """
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(_rows, _ROW)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
