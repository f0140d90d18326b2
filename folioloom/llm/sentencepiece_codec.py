"""SentencePiece encoding and decoding, with words of like length advancing together in numpy.

A text becomes units: a run of word marks (one for each space, one put before the
text) and what follows up to the next mark. No piece of such a vocabulary has a
mark behind another character, so units are encoded each for itself and a block's
distinct units once.

Units of like length advance together, one end after another: every substring's
hash probes the sorted piece keys, and of the pieces that end here the best
admissible one is kept with a backpointer to where it begins.
- For unigram models all pieces are admissible and the best sum of scores counts.
- The ids of a BPE model are not its best-scoring segmentation, but what is left
  when neighbours are merged best first. A segmentation is that one if each piece
  is what its own characters merge to and no merge crosses the border of any two
  neighbours while the two are merged alone. So a piece is admissible behind the
  last piece of the prefix before it if that border holds, which leaves one piece
  for each prefix. Borders are tried out once and remembered.
The kind is read from the model; the public 32,000-piece model is BPE.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx

MARK = "▁"
REMEMBERED = 400_000  # units
REMEMBERED_CHARS = 8 << 20
BORDERS = 2_000_000
TRIED = 1 << 20
CELLS = 1 << 17
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
FILL = 1 << 32  # behind a unit; no character
_CODECS: dict[str, Codec] = {}


class Codec:
    """Pieces, scores and lookup keys of a model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], unknown: int, bpe: bool):
        self.pieces, self.unknown, self.bpe = pieces, unknown, bpe
        self.scores = np.array(scores, np.float64)
        self.bytes = np.array([byte_ids.get(i, unknown) for i in range(256)], np.int64)
        self.special = special
        plain = [i for i in range(len(pieces)) if i not in special]
        self.longest = max((len(pieces[i]) for i in plain), default=1)
        self.by_text = {pieces[i]: i for i in plain}
        value = lambda s: int(self.keys_of(np.array([[ord(c) for c in s]], np.uint64))[0])
        keys = np.array([value(pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        self.out = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in byte_ids.items():
            self.out[i] = bytes([b])
        self.borders: dict[int, bool] = {}
        self.tried = np.zeros(TRIED, np.int64)
        if bpe:
            keep = np.array([self.merged(pieces[i])[0] == [pieces[i]] for i in self.ids], bool)
            self.keys, self.ids = self.keys[keep], self.ids[keep]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.remember()

    def remember(self) -> None:
        self.memory: dict[str, np.ndarray] = {}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        scores = [sp.get_score(i) for i in range(n)]
        # a BPE model's scores are minus the order of its merges: whole numbers; a unigram model's are log probabilities
        return cls(pieces, scores, byte_ids, special, sp.unk_id(), all(float(x).is_integer() for x in scores))

    @staticmethod
    def keys_of(rows: np.ndarray) -> np.ndarray:
        """One hash for each row of code points."""
        out = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j] + np.uint64(1)
        return tx.mix(out)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int64)
        some = np.nonzero(self.maybe[keys >> np.uint64(44)])  # most substrings are no piece, which their first bits tell
        keys = keys[some]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == keys, self.ids[at], -1)
        return out

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit; those of like length advance together, shorter ones filled up behind."""
        out: list = [None] * len(units)
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            # lengths in a block differ by a quarter at most
            most = max(int(length[order[at]]) * 5 // 4, 6)
            end = min(int(np.searchsorted(length[order], most, "right")), at + max(1, CELLS // most))
            part = order[at:end]
            own = length[part]
            size = int(own[-1])
            points = np.full((len(part), size), FILL, np.uint64)
            points[np.arange(size) < own[:, None]] = np.frombuffer("".join([units[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            for i, ids in zip(part.tolist(), self.viterbi(points, own), strict=True):
                out[i] = ids
            at = end
        return out

    def merged(self, text: str, border: int = -1) -> tuple[list[str], bool]:
        """What neighbours merge to, best score first and leftmost of equals; and whether a merge went over `border`, at which this stops."""
        parts, scores, ids = list(text), self.scores, self.by_text
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                joined = ids.get(parts[i] + parts[i + 1])
                if joined is not None and scores[joined] > best:
                    best, at = scores[joined], i
            if at < 0:
                return parts, False
            if border >= 0 and sum(map(len, parts[: at + 1])) == border:
                return parts, True
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def holds(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the border between two neighbours holds; it does at the start (-1) and at characters outside the vocabulary (less)."""
        if not self.bpe:
            return np.ones(len(piece), bool)
        out = (before < 0) | (piece < 0)
        some = np.flatnonzero(~out)
        keys = before[some] * len(self.pieces) + piece[some]
        borders = self.borders
        if len(borders) > BORDERS:
            borders.clear()
            self.tried = np.zeros(TRIED, np.int64)
        # a key is remembered twice with its answer: where its hash says, until another takes the place, and among all borders
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TRIED.bit_length() + 1)).astype(np.int64)
        known = self.tried[slot]
        new = np.flatnonzero(known >> 1 != keys + 1)
        if len(new):
            asked, back = np.unique(keys[new], return_inverse=True)
            answers = np.zeros(len(asked), np.int64)
            for i, key in enumerate(asked.tolist()):
                found = borders.get(key)
                if found is None:
                    left, right = self.pieces[key // len(self.pieces)], self.pieces[key % len(self.pieces)]
                    found = borders[key] = not self.merged(left + right, len(left))[1]
                answers[i] = found
            known[new] = keys[new] + 1 << 1 | answers[back]
            self.tried[slot[new]] = known[new]
        out[some] = known & 1 == 1
        return out

    def _spell(self, point: int) -> list[int]:
        raw = chr(point).encode("utf-8", "replace")
        return [self.unknown] if self.unknown in self.bytes[list(raw)] else self.bytes[list(raw)].tolist()

    def _found(self, points: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, start and id of all pieces in the rows, by end; a character of no piece is -2 - its code point."""
        n, size = points.shape
        whole, step = [], np.uint64(0x9E3779B97F4A7C15)
        key = np.zeros((n, size), np.uint64)
        for length in range(1, min(self.longest, size) + 1):
            key = key[:, : size - length + 1] * step + points[:, length - 1 :] + np.uint64(1)  # of the substrings that begin at each place
            ids = self.probe(tx.mix(key))
            if length == 1:
                ids = np.where(ids < 0, -2 - points.astype(np.int64), ids)
            row, start = np.nonzero((ids != -1) & (np.arange(length, size + 1) <= own[:, None]))
            whole.append((row, start, ids[row, start], start + length))
        row, start, ids, end = (np.concatenate(x) for x in zip(*whole, strict=True))
        order = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[order], np.arange(size + 2))
        row, start, ids = row[order], start[order], ids[order]
        return [(row[a:b], start[a:b], ids[a:b]) for a, b in zip(cut[1:-1], cut[2:], strict=True)]

    def viterbi(self, points: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Ids of each row, of whose points the first `own` count."""
        n, size = points.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        last = np.full((n, size + 1), -1, np.int64)
        worst = self.scores[self.ids].min() - 10 if len(self.ids) else -10.0
        for end, (row, start, ids) in enumerate(self._found(points, own), 1):
            score = best[row, start] + np.where(ids >= 0, self.scores[np.maximum(ids, 0)], worst)
            score[~self.holds(last[row, start], ids)] = -np.inf
            np.maximum.at(best[:, end], row, score)
            top = (score == best[row, end]) & (score > -np.inf)
            back[row[top], end], last[row[top], end] = start[top], ids[top]
        place, made = own.copy(), []
        while place.any():
            made.append(np.where(place > 0, last[np.arange(n), place], -1))
            place = np.where(place > 0, back[np.arange(n), place], 0)
        ids = np.stack(made[::-1], axis=1) if made else np.zeros((n, 0), np.int64)
        size = (ids != -1).sum(axis=1)
        end = np.cumsum(size)
        flat, strange = ids[ids != -1], (ids < -1).any(axis=1)
        return [self._spelled(flat[b - k : b]) if odd else flat[b - k : b] for k, b, odd in zip(size.tolist(), end.tolist(), strange.tolist(), strict=True)]

    def _spelled(self, found: np.ndarray) -> np.ndarray:
        return np.array([x for s in found.tolist() for x in ([s] if s >= 0 else self._spell(-2 - s))], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [UNIT.findall((MARK + text).replace(" ", MARK)) if text else [] for text in texts]
        new = list({u for own in units for u in own if u not in self.memory})
        if len(self.memory) + len(new) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.remember()
            new = list({u for own in units for u in own})
        self.held += sum(map(len, new))
        self.memory.update(zip(new, self.encode_units(new), strict=True))
        memory = self.memory
        return [np.concatenate([memory[u] for u in own]) if own else np.zeros(0, np.int64) for own in units]

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec.load(path)
    return _CODECS[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in tx.pieces(whole):
                texts = batch.column("text").to_pylist()
                ids = c.encode(texts)
                size = np.array([len(x) for x in ids])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
                decoded = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), lists, pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)])],
                    ["doc_id", "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return run


def sentencepiece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32, decoded_sha256 and round_trip of every row.

    Ids are those of the library for the model. Null texts count as empty and have no
    ids; null ids stay null; repeated rows give repeated rows. Other columns are
    ignored. `model` is a path that every executor has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encoded(model), "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def sentencepiece_decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(_decoded(model), "doc_id long, text string")


def op2_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_sentencepiece_codec": op2_sentencepiece_codec}
SQL: dict[str, str] = {}
