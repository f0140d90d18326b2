"""Token ids of whole texts by a public BPE tokenizer that drops white space.

Such a tokenizer never joins text across a space, so a text's ids are those of
its words put together. Where the tokenizer cuts words as in `CUTS`, a word of plain
characters is looked up in parts: its letters in lower case, each digit and what is
left, of which there are far fewer than words. Each block's distinct parts are looked
up, by their bytes, in a memory that lives as long as the Python worker; only new
ones are encoded.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import _text as tx

REMEMBERED = 600_000  # words
REMEMBERED_BYTES = 32 << 20
_MEMORY: dict[str, Memory] = {}
#: Normalizers and cuts under which letters, digits and the rest of a word are encoded each for itself, letters in either case alike.
CUTS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)
_OTHER, _LETTER, _DIGIT, _QUOTE, _STRANGE = range(5)
_KIND = np.full(256, _STRANGE, np.uint8)  # bytes of other characters, and controls
_KIND[33:127] = _OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _QUOTE
#: Whether there is a cut between two neighbours. A quote may begin a part that ends in letters, and marks of other bytes may join what stands before.
_CUT = np.zeros((5, 5), bool)
_CUT[_OTHER, [_LETTER, _DIGIT]] = _CUT[_LETTER, [_OTHER, _DIGIT, _QUOTE]] = _CUT[_DIGIT, [_OTHER, _LETTER, _DIGIT, _QUOTE]] = _CUT[_QUOTE, _DIGIT] = True


class Memory:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = ((told.get("normalizer") or {}).get("normalizers"), (told.get("pre_tokenizer") or {}).get("pretokenizers"))
        self.cuts = steps == CUTS
        #: Texts that are one id wherever they stand; words with one of them stay whole.
        self.whole = [x["content"].encode() for x in told.get("added_tokens", [])]
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; letters in lower case are what a cut leaves of them, so the model takes them as they are."""
        straight = [self.cuts and x.isalpha() and x.islower() for x in words]
        model = self.tokenizer.model
        others = iter(self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x, s in zip(words, straight, strict=True) if not s], add_special_tokens=False))
        return [[y.id for y in model.tokenize(x.decode())] if s else next(others).ids for x, s in zip(words, straight, strict=True)]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each of some distinct words stands."""
        more = sum(map(len, words))
        if len(self.place) + len(words) > REMEMBERED or self.bytes + more > REMEMBERED_BYTES:
            self.clear()
        place = self.place
        at = np.array([place.get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found = self.encoded(fresh)
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
            n = len(place)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(new) > len(self.begin):
                self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
            self.ids[self.used : self.used + len(flat)] = flat
            self.begin[n : n + len(new)] = self.used + np.cumsum(size) - size
            self.size[n : n + len(new)] = size
            self.used += len(flat)
            at[new] = n + np.arange(len(new))
            self.bytes += sum(map(len, fresh))
            place.update(zip(fresh, at[new].tolist(), strict=True))
        return at


def parts(memory: Memory, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words without what is between them, and length and document of the parts that are encoded each for itself."""
    ink = data[~tx._SPACE[data]]
    if not memory.cuts or not len(start):
        return ink, end - start, doc
    kind = _KIND[ink]
    cut = np.zeros(len(ink), bool)
    cut[1:] = _CUT[kind[:-1], kind[1:]]
    raw = ink.tobytes()
    for token in memory.whole:
        at = raw.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False
            at = raw.find(token, at + 1)
    begin = np.cumsum(end - start) - (end - start)
    cut[begin] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(ink)))
    doc = np.repeat(doc, np.diff(np.append(np.searchsorted(first, begin), len(first))))
    plain = np.add.reduceat(kind == _STRANGE, first, dtype=np.int64) == 0
    return np.where(np.repeat(plain, size), tx.lower(ink), ink), size, doc


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block one after another, and where each text's begin."""
    if path not in _MEMORY:
        _MEMORY[path] = Memory(path)
    memory = _MEMORY[path]
    data, off = tx.buffers(column)
    data, length, doc = parts(memory, data, *tx.words(data, off))
    words, _, back = tx.distinct(data, length)
    at = memory.places(words.to_pylist())
    size, begin = memory.size[at].astype(np.int32), memory.begin[at].astype(np.int32)
    size, begin = size[back], begin[back]
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    # one step from id to id, except where a part begins
    ids = memory.ids[np.repeat(begin - total[:-1].astype(np.int32), size) + np.arange(total[-1], dtype=np.int32)]
    return ids, total[np.searchsorted(doc, np.arange(len(off)))]
