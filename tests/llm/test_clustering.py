"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np

from folioloom.llm import centroid_clustering as cl

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n=400, seed=1, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(9)]
    rows = [(i, [np.float32(x + rng.gauss(0, 0.3 * spread)).item() for x in rng.choice(middles)], i) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[4][1], 0), (900, None, 0), (901, [1.0] * 63, 0), (902, [1.0] * 63 + [math.nan], 0), (903, [1.0] * 63 + [None], 0), (904, [math.inf] + [1.0] * 63, 0), (905, [], 0), (906, [0.0] * 64, None), (907, [0.0] * 64, 1)]
    return rows


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:clusters]
    centroids = [list(v) for _, v in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, near)], centroids


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, **how):
    got, centroids = cl.centroid_clusters(spark.createDataFrame(rows, SCHEMA), **how)
    want, middles = plain(rows)
    assert centroids == middles
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_rows(spark):
    """Nulls in every column, other lengths, non-finite components, repeated rows, equal vectors."""
    check(spark, vectors())


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, vectors()[:3])
    got, centroids = cl.centroid_clusters(spark.createDataFrame([(1, [1.0], 0)], SCHEMA))
    assert got.collect() == [] and centroids == []


def test_components_too_large_for_sums_of_squares(spark):
    rows = vectors(40, spread=1e7)[:40] + [(i + 50, [x * 3 for x in v], 0) for i, v, _ in vectors(40, seed=2, spread=1e6)[:40]]
    check(spark, rows)


def test_distances_beyond_a_long_are_null(spark):
    rows = [(i + 50, [(-1.0) ** i * 1e30] * 64, 0) for i in range(40)] + vectors(20)[:20]
    got, centroids = cl.centroid_clusters(spark.createDataFrame(rows, SCHEMA))
    want, middles = plain(rows)
    assert centroids == middles
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, n, d if d < 1 << 63 else None) for i, n, d in want), key=key)


def test_screening_measures_less_and_bounds_hold():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-500, 500, (16, 64)) * np.repeat(rng.integers(1, 20, (16, 8)), 8, axis=1)
    q = centroids[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 64))
    nearest, best, measured = cl.screened(q, cl.norms(q), centroids)
    exact = ((q[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (nearest == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 3000 * 16 / 4
    assert (cl._bounds(cl.norms(q), cl.norms(centroids)) <= exact).all()


def test_ties_go_to_the_smaller_number():
    centroids = np.zeros((3, 64), np.int64)
    centroids[:, 0] = [2, -2, 2]
    nearest, best, _ = cl.screened(np.zeros((1, 64), np.int64), np.zeros((1, 8)), centroids)
    assert nearest.tolist() == [0] and best.tolist() == [4]


def test_clashing_names_and_longer_vectors(spark):
    rows = spark.createDataFrame(vectors(60), SCHEMA).selectExpr("*", "1 as vector", "2 as norms", "3 as cluster", "4 as distance")
    assert cl.centroid_clusters(rows)[0].count() == 65
    rng = random.Random(1)
    wide = [(i, [rng.random() for _ in range(4096)], 0) for i in range(20)]
    got, centroids = cl.centroid_clusters(spark.createDataFrame(wide, SCHEMA), dimension=4096, clusters=4)
    assert got.count() == 20 and len(centroids) == 4 and len(centroids[0]) == 4096


def test_query_sums(spark):
    rows = cl.op13_centroid_clustering(spark, "/root/testdata/sf0.001").collect()
    own = {}
    for r in rows:
        own[r["cluster"]] = own.get(r["cluster"], 0) + r["distance"]
    assert all(r["cluster_inertia"] == own[r["cluster"]] and r["inertia"] == sum(own.values()) for r in rows)
