"""Substring dedup: removes words of long passages that already stood earlier.

Reference shards are suffix automata over words. A document is streamed through
the automaton of earlier text for its matching statistics (the longest match
that ends at each word); windows whose match reaches the threshold are removed.

Which shards a text must visit is decided by its seeds: windows with one word
sequence share a seed, so each seed has its own shards and only the fragments
round that seed are streamed through them. Nothing is broadcast, since the size
of a corpus' reference text has no bound; one automaton holds at most
SHARD_STATES states, and a seed with more text gets a further one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as rp
from . import _text as tx

SHARD_STATES = 200_000
HOT = 1024  # fragments that one seed may bring to one task


class Automaton:
    """A suffix automaton over word sequences added one after another."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def insert(self, words: list[bytes]) -> None:
        nxt, link, size = self.next, self.link, self.len
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if size[q] == size[last] + 1:
                    last = q
                    continue
                last = self._split(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A copy of state q for the shorter strings that reach it by w from p."""
        nxt, link, size = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        nxt, link, size = self.next, self.link, self.len
        state = long = 0
        out = []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                long = size[state]
            to = nxt[state].get(w)
            if to is None:
                state = long = 0
            else:
                state, long = to, long + 1
            out.append(long)
        return out


class Shards:
    """The matcher of one task: the automata of the current seed."""

    def __init__(self, length: int):
        self.length = length
        self.route = None

    def add(self, route: int, fragment: bytes, key: tuple, n: int, times: int) -> list[tuple]:
        if route != self.route:
            self.route, self.seen, self.automata, self.first = route, {fragment}, [], fragment
            return []
        d, h, s = key
        if fragment in self.seen:
            return [(d, h, s, s + n + self.length - 1)]
        self.seen.add(fragment)
        if not self.automata:  # the first fragment waits until there is something to hold against it
            self.automata = [Automaton()]
            self.automata[0].insert(self.first.split(b" "))
        words = fragment.split(b" ")
        hit = np.zeros(len(words), bool)
        for a in self.automata:
            hit |= np.array(a.statistics(words)) >= self.length
        if not hit[self.length - 1 :].all():
            if len(self.automata[-1].next) > SHARD_STATES:
                self.automata.append(Automaton())
            self.automata[-1].insert(words)
        turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        return [(d, h, s + int(a) - self.length + 1, s + int(b)) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]

    def close(self) -> list[tuple]:
        return []


def _kept(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                data, off = tx.buffers(batch.column("text"))
                data, start, end, doc = tx.joined(data, off)
                first = np.searchsorted(doc, np.arange(len(batch) + 1))
                n = np.diff(first)
                gone = rp.marks(batch, first)
                copy = np.asarray(batch.column("copy")) > 0
                gone |= np.repeat(copy & (n >= length), n)
                # bytes of the kept words, each with the space behind it
                stay = np.repeat(~gone, end - start + 1)
                rest = data[stay]
                size = np.zeros(len(batch) + 1, np.int64)
                total = np.concatenate([[0], np.cumsum((end - start + 1) * ~gone)])
                size = total[first]
                texts = [rest[a : max(a, b - 1)].tobytes() for a, b in zip(size[:-1], size[1:], strict=True)]
                lost = np.concatenate([[0], np.cumsum(gone)])
                ids = pa.compute.if_else(pa.compute.equal(batch.column("d"), rp.NO_ID), None, batch.column("d"))
                out = {"doc_id": ids, "n_words": pa.array(n), "n_removed": pa.array(lost[first[1:]] - lost[first[:-1]]), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
                if with_text:
                    out["kept"] = pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 5, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Removes each word covered by a window of `length` words that also starts earlier.

    Earlier means in a document with a smaller id, or before in the same one. Of
    rows with equal id the texts are ordered by hash; of equal rows one counts as
    the first. Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words
    left, joined by one space; only if with_text), one row for each input row. Null
    and empty texts have no words; a null id comes before all others and stays null.
    Other columns are ignored, so their names cannot clash.
    """
    rows = rp.covered(docs, id_col, text_col, "words", length, k, Shards, False, hot)
    return rows.select("d", "text", "copy", "spans").mapInArrow(_kept(length, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _emptied(length: int):
    """The texts left, with their rows' other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, out in zip(tx.pieces(whole), _kept(length, True)([whole]), strict=True):
                yield pa.RecordBatch.from_arrays([batch.column("other"), out.column("kept")], ["other", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 5, hot: int = HOT) -> DataFrame:
    """docs with each text reduced to the words that `substring_dedup` keeps (one space between them), n_chars following if there is one.

    Every row stays, even one left without words.
    """
    rows = rp.covered(docs, id_col, text_col, "words", length, k, Shards, False, hot, carry=True)
    kind = docs.drop(text_col).schema.simpleString()
    left = rows.select("d", "text", "copy", "spans", "other").mapInArrow(_emptied(length), f"other {kind}, kept string")
    value = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(value.get(c, F.col(f"other.`{c}`")).alias(c) for c in docs.columns))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL: dict[str, str] = {}
