"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from folioloom.llm import period_runs as pr

from .helpers import SCHEMA, WORD, documents, frame, prose


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and not any(w[s : s + n - r] == w[s + r : s + n] for r in range(1, q)):
                found.append((s, n, q))
            i += 1
    return sorted(found)


def plain_row(doc_id, text):
    words = WORD.findall((text or "").encode())
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = sorted(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))[:1]  # exponents of short runs differ by more than rounding
    s, m, q = best[0] if best else (None, None, None)
    told = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
    kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
    return doc_id, len(found), s, m, q, 1000 * m // q if best else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(600):
        texts, flat, ends = [], [], []
        k = rng.randint(1, 4)
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
            at = rng.randint(0, len(w))
            w[at:at] = [rng.randrange(k) for _ in range(rng.randint(1, 7))] * rng.randint(1, 9)
            texts.append((len(flat), w))
            flat += w
            ends.append(len(flat))
            flat.append(0)
        want = sorted((s + base, n, q) for base, w in texts for s, n, q in plain_runs(w))
        assert [tuple(x) for x in pr.runs(np.array(flat), np.array(ends)).tolist()] == want


def test_lyndon_edges():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        whole = np.array([*w, 0])
        shared = pr.Extensions(np.array([*w, 9]))
        order = np.array([*w, -1])
        i, j, common = pr.lyndon_edges(shared, order, np.array([len(w)]))
        got = dict(zip(i.tolist(), zip(j.tolist(), common.tolist(), strict=True), strict=True))
        suffix = [[*w[x:], -1] for x in range(len(w) + 1)]
        for x in range(len(w)):
            after = next(y for y in range(x + 1, len(w) + 1) if suffix[y] < suffix[x])
            same = 0
            while after + same < len(w) and whole[x + same] == whole[after + same]:
                same += 1
            assert got.get(x, (after, 0)) == (after, same)


def test_texts_full_of_repeats_take_little_time():
    n = 100_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    for w in ([0] * n, [0, 1] * (n // 2), b[:n], [bin(i).count("1") & 1 for i in range(n)], ([0] * 300 + [1]) * (n // 301), list(range(n)), [*range(n // 2), *range(n // 2, 0, -1)], list(range(1000)) * (n // 1000)):
        began = time.time()
        found = pr.runs(np.array([*w, 0]), np.array([len(w)]))
        assert time.time() - began < 10
        assert len(found) < len(w)
    assert pr.runs(np.array([0] * n + [0]), np.array([n])).tolist() == [[0, n, 1]]


def test_refuses_few_periods():
    with pytest.raises(ValueError):
        pr.runs(np.zeros(1, np.int64), np.zeros(1, np.int64), times=2)


def test_query_rows(spark):
    """Against brute force: copies, repeats, odd white space, empty texts, nulls in every column, repeated rows."""
    rng = random.Random(9)
    rows = documents() + [(1000 + i, f"{prose(rng, 7)} " + f"{prose(rng, rng.randint(1, 4))} " * rng.randint(3, 9) + prose(rng, 5), "en", "s", 0) for i in range(150)]
    got = pr.run_digests(frame(spark, rows)).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 50


def test_operator_returns_runs_and_texts(spark):
    rows = [(1, "a b " * 5 + "c", None, None, None), (2, None, None, None, None), (None, " x\ty ", None, None, None)]
    got = {r["doc_id"]: r for r in pr.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 10, 2)] and got[1]["collapsed"] == "a b c"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[None]["collapsed"] == "x y"


def test_very_long_empty_table_and_clashing_names(spark):
    text = prose(random.Random(2), 150_000) + " tick tock" * 60_000
    rows = frame(spark, [(11, text, "en", "s", 0)]).selectExpr("*", "1 as start", "2 as n_runs", "3 as period")
    got = pr.run_digests(rows).first()
    assert (got["length"], got["period"]) in {(120_000, 2), (120_001, 2)} or zlib.crc32(b"11") % 10 == 0
    assert pr.run_digests(frame(spark, [], SCHEMA)).collect() == []
    assert re.fullmatch("[0-9a-f]{64}", got["runs_sha256"])
