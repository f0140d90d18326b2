"""Byte-level helpers over Arrow string columns, used inside tasks.

Everything works on UTF-8 bytes. The word separators 0x20 and 0x09-0x0D are
single bytes, so word bounds found on bytes are exact for any text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15  # any odd number serves
_PRIME = (1 << 31) - 1
_BASES = (0x2F0B4C47, 0x5A3D91E3)  # any numbers below the prime serve
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
STEP = 1 << 19


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for any x below 2**64."""
    prime, bits = np.uint64(_PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    x = (x & prime) + (x >> bits)
    return np.where(x >= prime, x - prime, x)


def powers(n: int, base: int, prime: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or modulo 2**31 - 1 (in 32 bits)."""
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        # rounded up, so that blocks of nearly one size share a table
        size = -(-n // (1 << 16)) << 16
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), _PRIME if prime else 1 << 64))
            more = have[: size - len(have)] * step
            have = np.concatenate([have, _folded(more) if prime else more])
        have = have.astype(np.uint32) if prime else have
        if n <= 2 * STEP:
            _POWERS[base, prime] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _give_back() -> None:
    """Returns what a worker has freed to the system, since workers live long and stand beside each other."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, name: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `step` bytes of text (one long text may exceed it)."""
    if not len(batch):
        return
    _, off = buffers(batch.column(name))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(off, off[at] + step, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    _give_back()


def distinct(data: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Byte strings that stand one after another in `data`, told apart by their bytes: the distinct ones, where each first stands, and each one's number."""
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    every = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    number = np.asarray(coded.indices).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(size) - 1, -1, -1)  # the last to be put is the first to stand
    return coded.dictionary, first, number


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """`distinct` of the words that `words` found."""
    return distinct(data[~_SPACE[data]], end - start)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word `[^\\x20\\x09-\\x0D]+`."""
    ink = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~ink[:-1]
        after[-1], after[:-1] = True, ~ink[1:]
    start = np.flatnonzero(ink & (before | edge[:-1]))
    end = np.flatnonzero(ink & (after | edge[1:])) + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return start, end, doc


_INVERSE = pow(_P, -1, 1 << 64)
_INVERSES = tuple(pow(x, -1, _PRIME) for x in _BASES)


def rough_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for `rough`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _P), out=out[1:])
    return out


def rough(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cheap hashes of byte ranges for choosing candidates only: equal for equal bytes, but some unequal strings always agree."""
    return mix((sums[end] - sums[start]) * powers(len(sums), _INVERSE)[start] + (end - start).astype(np.uint64))


def prefix(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Prefix sums from which `ranges` has the hash of any byte range."""
    wide, out = data.astype(np.uint64) + np.uint64(1), []
    for base in _BASES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_folded(wide * powers(len(data), base, True).astype(np.uint64)), out=sums[1:])
        out.append(sums)
    return tuple(out)


def ranges(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand: polynomials of two bases modulo a prime, with the length."""
    out = (end - start).astype(np.uint64)
    for own, inverse in zip(sums, _INVERSES, strict=True):
        out = out * np.uint64(_P) ^ _folded(_folded(own[end] - own[start]) * powers(len(own), inverse, True)[start].astype(np.uint64)) << np.uint64(16)
    return mix(out)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes (n - k + 1 of them)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    out = values[: n - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[i : n - k + 1 + i]
    return mix(out)


def joined(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words put together with one space after each: bytes, starts, ends, document numbers."""
    start, end, doc = words(data, off)
    size = end - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    keep = ~_SPACE[data]
    ink = np.ones(at[-1], bool)
    ink[at[1:] - 1] = False
    out[ink] = data[keep]
    return out, at[:-1], at[:-1] + size, doc


def least(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (n - w + 1 of them), by block prefixes and suffixes."""
    n = len(values)
    if n < w:
        return values[:0]
    full = -(-n // w) * w
    block = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    block[:n] = values
    block = block.reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def key_columns(batch: pa.RecordBatch, names: list[str], take: np.ndarray) -> list[pa.Array]:
    return [batch.column(x).take(pa.array(take)) for x in names]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(size.sum())
