"""Closeness of short strings by longest matching blocks (Ratcliff-Obershelp), and the closest of a few headers.

Equal cells are looked at once. A header is skipped unless the lengths allow its ratio
and, if they do, the letters in common: both bound the ratio from above.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF = 0.72
MOST_WORDS = 5


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """Begin in a, begin in b and length of the longest common block; of equals the first in a, then in b."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                n = now[j + 1] = before[j] + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
        before = now
    return best


def matched(a: str, b: str) -> int:
    """Letters in matching blocks: the longest one, and those left and right of it."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        i, j, n = _longest(a, b)
        if n:
            total += n
            todo += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def ratio(a: str, b: str) -> float:
    """2 * matched letters / all letters; b should be the shorter text, since the measure is not symmetric in ties."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def closest(cell: str, headers: list[str], cutoff: float = CUTOFF) -> tuple[str, float] | None:
    """The header with the greatest ratio of at least `cutoff`; of equals the one that sorts last. Headers and cell in capitals."""
    best = None
    letters = Counter(cell)
    for header in headers:
        both, least = len(cell) + len(header), max(cutoff, best[0] if best else 0)
        if 2 * min(len(cell), len(header)) < least * both or 2 * sum((letters & Counter(header)).values()) < least * both:
            continue
        found = (ratio(header, cell), header)
        if found[0] >= cutoff and (best is None or found > best):
            best = found
    return (best[1], best[0]) if best else None


def candidate(cell, headers: list[str]):
    """The cell as words of capitals, or null: blank, over five words, a plural of services, or one word that begins no header."""
    words = F.upper(F.trim(F.regexp_replace(F.regexp_replace(cell, "[^A-Za-z ]", " "), r"\s+", " ")))
    n = F.size(F.split(words, " "))
    alone = [h.split()[0].upper() for h in headers]
    return F.when((words != "") & (n <= MOST_WORDS) & ~F.endswith(words, F.lit("SERVICES")) & ((n > 1) | words.isin(alone)), words)


def closest_headers(cells: DataFrame, column: str, headers: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """The cells that are nearly one of the headers, with `header` and `ratio`.

    Each distinct candidate is compared once, wherever and however often it stands;
    the few that match, at most as many as there are spellings, are joined back.
    """
    known = {h.upper(): h for h in headers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, closest(k, list(known), cutoff)) for k in batch.column("k").to_pylist()]
            rows = [(k, known[f[0]], f[1]) for k, f in found if f]
            yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows], pa.string()), "header": pa.array([r[1] for r in rows], pa.string()), "ratio": pa.array([r[2] for r in rows], pa.float64())})

    keyed = cells.withColumn("k", candidate(F.col(column), headers)).where(F.col("k").isNotNull())
    rated = keyed.select("k").distinct().mapInArrow(run, "k string, header string, ratio double")
    return keyed.join(rated, "k").drop("k")
