"""Centroid clustering of integer vectors with block-norm screening.

Each vector is quantised to integers and compressed to the norms of its segments of
eight components. By Cauchy-Schwarz, the squared distance of vector and centroid is at
least the sum over segments of the squared difference of their norms. The centroid
with the least bound is measured first; of the others only those whose bound does not
exceed the least distance so far get an exact distance, in integers.

Vectors are quantised and compressed once, into the shared folder. Each round reads
them beside at most `clusters` centroids, and each task sums what it has assigned
before anything is shuffled, so a large cluster is no task's burden.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _components as cc

DIMENSION = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEGMENT = 8
SEED = 1
NARROW = 1 << 27  # below it distances of vectors of 64 components stay below 2**62
ROWS = 8192  # vectors looked at together
_LONG = 1 << 63
_STORED = "vec_id long, vector binary, norms binary, wide boolean"


def norms(q: np.ndarray) -> np.ndarray:
    """Of each segment of each row, as doubles."""
    return np.sqrt((q.astype(np.float64).reshape(len(q), -1, SEGMENT) ** 2).sum(axis=2))


def _quantise(dimension: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
                with np.errstate(over="ignore"):
                    scaled = np.floor(x * scale)  # exact: scale is a power of two
                wide = ~(np.abs(scaled) < NARROW).all(axis=1)
                q = np.where(wide[:, None], 0, scaled).astype("<i4")
                stored = [r.tobytes() for r in q]
                for i in np.flatnonzero(wide):  # too large for 64-bit sums of squares: whole numbers as text
                    stored[i] = ",".join(str(_floor(v, scale)) for v in x[i].tolist()).encode()
                compressed = norms(q)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).cast(pa.int64()), "vector": pa.array(stored, pa.binary()),
                    "norms": pa.array([r.tobytes() for r in compressed], pa.binary()), "wide": pa.array(wide),
                })

    return run


def _floor(v: float, scale: int) -> int:
    over, under = v.as_integer_ratio()
    return over * scale // under


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (32-bit integers, or text where too large), norms (of segments, doubles) and wide of the vectors with `dimension` components, none null or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).mapInArrow(_quantise(dimension, scale), _STORED)


def unpacked(stored: bytes, wide: bool) -> list[int]:
    return [int(x) for x in stored.split(b",")] if wide else np.frombuffer(stored, "<i4").tolist()


def _bounds(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances (rows, centroids) from segment norms, a little below what rounding could add."""
    out = np.zeros((len(own), len(others)))
    for s in range(own.shape[1]):
        a, b = own[:, s, None], others[None, :, s]
        out += np.maximum(np.abs(a - b) - 1e-12 * (a + b), 0) ** 2
    return out * (1 - 1e-12)


def screened(q: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact distances that took."""
    bound = _bounds(compressed, norms(centroids))
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(len(q), np.iinfo(np.int64).max)
    nearest = np.full(len(q), len(centroids), np.int64)
    measured = 0
    for rank in range(len(centroids)):
        number = order[:, rank]
        open_ = np.flatnonzero(bound[np.arange(len(q)), number] <= best)
        if not len(open_):
            break  # later bounds are greater still
        number = number[open_]
        d = q[open_] - centroids[number]
        d = np.einsum("ij,ij->i", d, d)
        better = (d < best[open_]) | (d == best[open_]) & (number < nearest[open_])
        best[open_[better]], nearest[open_[better]] = d[better], number[better]
        measured += len(open_)
    return nearest, best, measured


def _nearest(batch: pa.RecordBatch, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Row numbers, their clusters, squared distances and vectors; Python's integers where 64 bits may not do."""
    wide = batch.column("wide").to_numpy(zero_copy_only=False).astype(bool)
    large = any(abs(x) > NARROW for c in centroids for x in c)  # every row is then compared in Python's integers
    plain = np.flatnonzero(~wide) if not large else np.zeros(0, np.int64)
    if len(plain):
        taken = batch.take(pa.array(plain))
        q = np.frombuffer(b"".join(taken.column("vector").to_pylist()), "<i4").astype(np.int64).reshape(len(plain), -1)
        compressed = np.frombuffer(b"".join(taken.column("norms").to_pylist()), "<f8").reshape(len(plain), -1)
        cluster, distance, _ = screened(q, compressed, np.array(centroids, np.int64))
        yield plain, cluster, distance.tolist(), q
    rest = np.arange(len(wide)) if large else np.flatnonzero(wide)
    if len(rest):
        taken = batch.take(pa.array(rest))
        q = [unpacked(v, w) for v, w in zip(taken.column("vector").to_pylist(), wide[rest], strict=True)]
        found = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids)) for x in q]
        yield rest, np.array([n for _, n in found]), [d for d, _ in found], np.array(q, dtype=object)


def _limbs(x: int) -> list[int]:
    """x as signed digits of base 2**32, least first, so that a long can hold sums of millions of them."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & 0xFFFFFFFF))
        x >>= 32
    return out


def _sums(centroids: list[list[int]]):
    """Size of each cluster (place -1) and sum of each component (places 0, 1, ...) over the whole partition, limb by limb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for _, cluster, _, q in _nearest(batch.slice(at, ROWS), centroids):
                    for n in np.unique(cluster).tolist():
                        own = q[cluster == n]
                        before = total.get(n, [0] * (1 + own.shape[1]))
                        total[n] = [a + int(b) for a, b in zip(before, [len(own), *own.sum(axis=0)], strict=True)]
        rows = [(n, place - 1, k, limb) for n, sums in total.items() for place, x in enumerate(sums) for k, limb in enumerate(_limbs(x))]
        if rows:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "limb", "x"])

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                for rows, cluster, distance, _ in _nearest(part, centroids):
                    fit = pa.array([d if d < _LONG else None for d in distance], pa.int64())
                    yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id").take(pa.array(rows)), "cluster": pa.array(cluster, pa.int32()), "distance": fit})

    return run


def first_centroids(stored: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least SHA-256 of `seed:vec_id`, in that order; those with equal ids in order of their bytes."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = stored.select(by.alias("by"), "vector", "wide").orderBy("by", "wide", "vector").limit(clusters).collect()
    return [unpacked(bytes(r["vector"]), r["wide"]) for r in rows]


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every kept vector; and the final centroids.

    Vectors that are null, of another dimension, or hold null or non-finite components
    are left out. Null ids stay null and count as empty when first centroids are drawn;
    repeated rows are rows of their own; ties go to the smaller number; a table without
    kept vectors gives no row and no centroid; other columns are ignored. Components of
    any size are exact; a distance that a long cannot hold is null. `scale` must be a
    power of two and `dimension` a multiple of 8. A dimension of thousands is one row's.
    """
    cc.prepare(df)
    stored = kept_vectors(df, id_col, vector_col, dimension, scale).checkpoint()
    centroids = first_centroids(stored, clusters, seed)
    for _ in range(rounds if centroids else 0):
        sums = stored.mapInArrow(_sums(centroids), "cluster long, place long, limb long, x long").groupBy("cluster", "place", "limb").agg(F.sum("x").alias("x"))
        found: dict[int, list[int]] = {}
        for r in sums.collect():  # a few rows for each component of each centroid
            found.setdefault(r["cluster"], [0] * (1 + dimension))[r["place"] + 1] += r["x"] << 32 * r["limb"]
        for n, (size, *own) in found.items():
            centroids[n] = [x // size for x in own]
    return stored.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.checkpoint()
    own = rows.groupBy("cluster").agg(F.expr("try_sum(cast(distance as decimal(38, 0)))").alias("exact"))
    told = own.select("cluster", F.expr("try_cast(exact as long)").alias("cluster_inertia"), F.expr("try_cast(try_sum(exact) over () as long)").alias("inertia"))  # a row a cluster
    digests = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(centroids)]
    told = told.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    steps = [f"""
kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INT AS c, v AS m FROM kept ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS})"""]  # fmt: skip
    apart = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (SELECT vec_id, v, c, {apart} AS d FROM kept, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range({DIMENSION})) AS p FROM a{i}) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY p) AS m FROM s{i} GROUP BY c) n ON n.c = c{i}.c)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, best.c AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
SQL = {"op13_centroid_clustering": _sql()}
