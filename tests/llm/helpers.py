"""Brute-force versions and fixtures."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in ("ba", "ko", "ri", "tu", "ze", "lo", "mi") for b in ("na", "so", "ve", "qui", "ü", "'s", "n.")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents(seed=1):
    """Texts with copies, near copies, shared passages, runs of one word, odd white space, nulls, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(30)]
    shared, line = prose(rng, 70), prose(rng, 24)
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 30)}" for _ in range(4)]
    texts += [f"{line}\n{prose(rng, 5)}\n{line}" for _ in range(3)]
    texts += [texts[0], texts[5], texts[5], texts[7] + " more", "x " + texts[7]]
    texts += ["run " * 90, "ab ab cd " * 60, "", " \t\n", None, None, "one", "ÀÉ ñ 漢字 漢字 " * 40, "a" * 700]
    words = texts[9].split()
    words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
    texts.append(" ".join(words))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], "en", "s", 0), (None, None, None, None, None), (7, "other text with an id that repeats", "en", "s", 0)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def lowered(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def roots(ids, linked):
    """Least member reachable from each index, by union-find over all pairs."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, v in enumerate(ids):
        key = (v is not None, v)
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return [least[find(i)][1] for i in range(len(ids))]
