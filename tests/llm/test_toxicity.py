import random
import time
import zlib

import numpy as np

from folioloom.llm import toxicity as tx
from tests.llm.helpers import frame, prose


def brute_segments(score):
    """Recursive definition: the best segment, then both sides of it."""
    out = []

    def split(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(score[i:j])
                if s > best + 1e-9 or (at and abs(s - best) < 1e-9 and j - i < at[1] - at[0]):
                    best, at = s, (i, j)
        if at:
            split(a, at[0])
            out.append((*at, best))
            split(at[1], b)

    split(0, len(score))
    return out


def test_scan_finds_all_maximal_segments():
    rng = np.random.default_rng(0)
    for _ in range(40):
        score = rng.choice([-2.3, -1.1, -0.4, 1.7, 2.9, 0.6], 14)
        got = tx.segments(score)
        want = brute_segments(score.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_scan_is_linear():
    """A million alternating tokens, every candidate staying or every one joining, take about as long a token as few do."""
    for score in (np.tile([1.0, -2.0], 500_000), np.tile([2.0, -1.0], 500_000), np.tile([3.0, -3.0], 500_000) - np.repeat(np.linspace(0, 1, 500_000), 2)):
        began = time.process_time()
        tx.segments(score)
        assert time.process_time() - began < 5


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        text = prose(rng, rng.randint(20, 90))
        toxic = i % 9 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["vile", "scoundrel", "rotten"]))
            text = " ".join(w)
        rows.append((i, text, "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(None, "vile rotten scoundrel", "en", "s", 0), (5000, None, "en", "s", 0), (5001, "", "en", "s", 0), rows[9]]
    got = tx.toxicity(frame(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 4
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert next(r for r in got if r.doc_id is None).predicted == 1
    low = min(r.score for r in got)
    assert all(r.score == low for r in got if r.doc_id in (5000, 5001))
    clean = tx.without_toxic(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in clean.collect()}
    assert sum(truth[i] for i in kept) <= 2 and sum(1 - t for i, t in truth.items() if i not in kept) <= 2


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, _ = corpus()
    assert {r.predicted for r in tx.toxicity(frame(spark, rows[:20]), none).collect()} == {0}
    assert tx.toxicity(frame(spark, []), none).count() == 0
