"""Suffix-array and substring dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from folioloom.llm import suffix_array_dedup as sa
from folioloom.llm.substring_dedup import Automaton, substring_dedup, without_repeats
from tests.llm.helpers import SCHEMA, WORD, documents, frame


def digest(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), digest(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return Counter(out)


def brute_words(rows, length):
    """Order of equal ids is by text hash in the operator, so only rows with one text an id are compared by value."""
    texts = sorted(((r[0], WORD.findall((r[1] or "").encode())) for r in rows), key=lambda x: (x[0] is not None, x[0]))
    seen, out = set(), []
    for d, w in texts:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = True
            seen.add(key)
        out.append((d, len(w), int(gone.sum()), digest(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return Counter(out)


@pytest.mark.parametrize(("seed", "length", "k"), [(1, 200, 32), (2, 60, 8)])
def test_bytes(spark, seed, length, k):
    rows = documents(seed)
    got = Counter(tuple(r)[:5] for r in sa.suffix_array_dedup(frame(spark, rows), length=length, k=k).collect())
    assert got == brute_bytes(rows, length)


@pytest.mark.parametrize(("seed", "length", "k"), [(1, 20, 5), (3, 8, 3)])
def test_words(spark, seed, length, k):
    rows = documents(seed)
    got = Counter(tuple(r)[:4] for r in substring_dedup(frame(spark, rows), length=length, k=k).collect())
    assert got == brute_words(rows, length)


def test_many_small_batches_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 101, 400, dtype=np.uint8))
    family, plain = sa.Family(40), Counter()
    monkeypatch.setattr(sa, "BATCH", 150)
    found, fragments = [], []
    for i in range(40):
        at = int(rng.integers(0, 300))
        f = bytearray(base[at : at + int(rng.integers(45, 95))])
        f[int(rng.integers(0, len(f)))] = 120
        fragments.append(bytes(f))
        found += family.add(1, bytes(f), (i, 0, 0), len(f) - 39, 1)
    found += family.close()
    for f in set(fragments):
        plain.update({f[i : i + 40] for i in range(len(f) - 39)})
    times = Counter(fragments)
    for i, f in enumerate(fragments):
        want = {p for s in range(len(f) - 39) if plain[f[s : s + 40]] > 1 or times[f] > 1 for p in range(s, s + 40)}
        got = {p for d, _, a, b in found if d == i for p in range(a, b)}
        assert got == want


def test_automaton_statistics():
    a = Automaton()
    for text in (b"a b c a b d", b"b c e", b"a b c a b d", b"c a b"):
        a.insert(text.split())
    texts = [b"a b c a b d".split(), b"b c e".split()]
    query = b"x b c a b e b c e a".split()
    want = [max((k for k in range(1, i + 2) for t in texts for s in range(len(t) - k + 1) if t[s : s + k] == query[i + 1 - k : i + 1]), default=0) for i in range(len(query))]
    assert a.statistics(query) == want


def test_empty_table_and_clashing_columns(spark):
    none = frame(spark, [])
    assert sa.suffix_array_dedup(none).count() == 0
    assert substring_dedup(none).count() == 0
    odd = spark.createDataFrame([(1, "w " * 30, 5, 6, 7), (2, "w " * 30, 5, 6, 7)], "doc_id long, text string, d long, h long, spans long")
    assert {r.doc_id: r.n_removed for r in substring_dedup(odd).collect()} == {1: 29, 2: 30}
    left = without_repeats(odd)
    assert left.columns == odd.columns
    assert left.count() == 2


def test_without_repeats_keeps_columns(spark):
    rows = documents(4)
    df = frame(spark, rows)
    left = without_repeats(df)
    assert left.schema.simpleString() == df.schema.simpleString()
    assert left.count() == len(rows)
    assert SCHEMA
