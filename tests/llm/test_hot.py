"""Seeds that stand in very many texts, and words that a weak hash takes for equal."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioloom.llm import _components as cc
from folioloom.llm import suffix_array_dedup as sa
from folioloom.llm._repeats import Windows
from folioloom.llm.best_fit_packing import best_fit_packing
from folioloom.llm.lm_scoring import lm_scores
from folioloom.llm.substring_dedup import substring_dedup
from tests.llm.helpers import documents, frame, prose
from tests.llm.test_repeats import brute_bytes, brute_words


def thue_morse(turn, n=2048):
    """Two words whose polynomial hashes modulo 2**64 agree for every odd base."""
    return "".join("ab"[(i.bit_count() + turn) % 2] for i in range(n))


def common_line(seed):
    """One line in every text, mostly among other words, and some longer passages round it that repeat."""
    rng = random.Random(seed)
    line, wide = prose(rng, 9), [prose(rng, 8) for _ in range(3)]
    rows = []
    for i in range(120):
        before, behind = rng.choice([prose(rng, 30), wide[0], wide[1]]), rng.choice([prose(rng, 30), wide[2], wide[0]])
        rows.append((1000 + i, f"{prose(rng, rng.randint(0, 12))} {before} {line} {behind} {prose(rng, 4)}", "en", "s", 0))
    return rows + documents(seed)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_seeds(spark, seed):
    rows = common_line(seed)
    got = Counter(tuple(r)[:5] for r in sa.suffix_array_dedup(frame(spark, rows), length=60, k=8, hot=3).collect())
    assert got == brute_bytes(rows, 60)
    got = Counter(tuple(r)[:4] for r in substring_dedup(frame(spark, rows), length=12, k=3, hot=3).collect())
    assert got == brute_words(rows, 12)


@pytest.mark.parametrize("both", [True, False])
def test_windows_over_batches(both):
    rng = np.random.default_rng(3)
    n = 300
    rows = np.stack([np.sort(rng.integers(0, 90, n)), np.zeros(n, np.int64), np.arange(n), np.arange(n), np.arange(n), rng.integers(1, 3, n)])
    w, found = Windows(both), []
    at = 0
    while at < n:
        step = int(rng.integers(1, 6))
        found += w.add(list(rows[:, at : at + step]))[:, 0].tolist()
        at += step
    times = Counter(rows[0].tolist())
    want = [i for i in range(n) if (both and (times[int(rows[0, i])] > 1 or rows[5, i] > 1)) or (not both and i and rows[0, i] == rows[0, i - 1])]
    assert found == want


def test_words_that_a_weak_hash_takes_for_equal(spark):
    a, b = thue_morse(0), thue_morse(1)
    start = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{start} {a}", "en", "s", 0), (2, f"{start} {b}", "en", "s", 0)]
    for parts in (1, 2):
        assert {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows).repartition(parts)).collect()} == {1: 0, 2: 0}
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in ((1, a), (2, b))}
    assert {r.doc_id: r.ids_crc32 for r in best_fit_packing(frame(spark, [(1, a, "", "", 0), (2, b, "", "", 0)]), path).collect()} == want
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r.doc_id: r for r in lm_scores(frame(spark, [(train, a, "", "", 0), (held, b, "", "", 0)])).collect()}
    assert (got[train].n_known, got[held].n_known) == (2, 1)


def test_join_counted(spark, monkeypatch):
    monkeypatch.setattr(cc, "FEW", 5)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(200)], "k long, v long")
    groups = rows.groupBy("k").count()
    got = cc.join_counted(rows, groups, ["k"], "count", 200).collect()
    assert len(got) == 200
    assert {(r.k, r["count"]) for r in got} == {(r.k, r["count"]) for r in groups.collect()}
