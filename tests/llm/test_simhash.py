import random

import numpy as np
import pytest
import xxhash

from folioloom.llm import simhash_near_dedup as sd
from tests.llm.helpers import WORD, documents, frame, lowered, roots


def brute_print(text, k):
    w = WORD.findall(lowered((text or "").encode()))
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_against_brute_force(spark):
    rows = documents()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in sd.simhash_near_dedup(frame(spark, rows), k=4).collect()), key=str)
    prints = [brute_print(r[1], 4) for r in rows]
    root = roots([r[0] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert got == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, root, strict=True)), key=str)


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_no_link_is_missed(spark, radius):
    rng = np.random.default_rng(radius)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    for p in list(prints):
        for bits in (1, radius, radius + 1):
            for b in rng.choice(64, bits, replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    hub = prints[0]
    prints += [hub ^ 1 << i for i in range(64)]  # one crowded key
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(i, s, b"", 0) for i, s in enumerate(signed)], "node long, print long, more binary, block long")
    got = {r.node: r.root for r in sd.near(nodes, radius).collect()}
    want = roots(list(range(len(prints))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)
    assert [got.get(i, i) for i in range(len(prints))] == want


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_keep_one(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(25)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        w[int(rng.integers(20, 280))] = "edited"
        near = " ".join(w)
        assert jaccard(t, near) > 0.8
        rows.append((100 + i, near, "en", "s", 0))
    rows += [(200, base[20], "en", "s", 0), rows[24], (300, None, "en", "s", 0), (301, "", "en", "s", 0)]
    left = sd.keep_one(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in left.collect()) == [*range(25), 300]
    assert sd.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_acts_at_the_exact_similarity(spark, seed):
    """Edits, appended and cut texts round 0.8, unrelated texts with a common line, short texts and repeated words."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = ["one two", "one two", "one two three", "a b c d e f", "a b c d e f g", "run " * 40, "run " * 41, "", " "]
    line = " ".join(rng.choice(words, 24))
    texts += [f"{line} {' '.join(rng.choice(words, 60))}" for _ in range(60)]
    wanted = []
    for goal in (0.6, 0.7, 0.79, 0.8, 0.85) * 6:
        base = list(rng.choice(words, 300))
        for kind in ("edits", "append", "cut"):
            w, order = list(base), rng.permutation(np.arange(5, 295))
            for i in order:
                if kind == "edits":
                    v = list(w)
                    v[i] = "edited"
                else:
                    v = [*w, str(rng.choice(words))] if kind == "append" else w[:-1]
                if jaccard(" ".join(base), " ".join(v)) < goal:
                    break
                w = v
            if kind != "edits" and goal in (0.7, 0.79):
                w = v  # just below
            texts += [" ".join(w)]
            wanted.append(jaccard(" ".join(base), " ".join(w)))
        texts.append(" ".join(base))
    assert sum(x >= 0.8 for x in wanted) >= 30 and sum(0.65 < x < 0.8 for x in wanted) >= 20
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in texts]
    root = roots(list(range(len(texts))), lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    left = sd.keep_one(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root))


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = rng.integers(0, 1 << 47, n)
        b = np.concatenate([a[: int(rng.integers(0, n + 1))], rng.integers(0, 1 << 47, int(rng.integers(0, 60)))])
        x, y = sd.parities([a, b]).view(np.uint64)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_many_texts_that_share_not_quite_four_fifths(spark):
    """Versions of one text that differ in six or seven places each: few pairs are similar, and all of those are found."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 6, 7, 8])):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    sets = [{tuple(r[1].split()[j : j + 5]) for j in range(len(r[1].split()) - 4)} for r in rows]
    want = {r for r in roots(list(range(400)), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))}
    assert {r.doc_id for r in sd.keep_one(frame(spark, rows)).collect()} == want
