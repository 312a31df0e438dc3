"""Operator 12: k-means in whole numbers, assigned by partial-distance search.

Vectors become whole numbers once and are written; each round is one scan. In a task, the squared differences over the dimensions of
highest variance come first, for all centroids; the nearest by these is finished and is the first best. Any other centroid is
abandoned, row by row, as soon as its partial sum is strictly above the best, and survivors finish all dimensions, so ties stay exact: the smaller number wins.
The order of the dimensions only decides how early sums are abandoned, never the result.

A round sends one row a centroid and task: its number of vectors and the sums of their components, added exactly by Spark. The driver holds the centroids alone.

A vector is kept if it has exactly ``DIMENSIONS`` components, none of them null, not a number, infinite, or of 2^20 or more in size (squared
distances of such would not fit 64 bits). Null ids count as 'null' in the choice of the first centroids; rows that repeat an id are vectors of their own, ordered by their components
where hashes tie. With fewer vectors than centroids each vector is a centroid; equal centroids leave the later one empty, and empty ones stay. Without a kept vector the result is empty. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

DIMENSIONS, SCALE, LARGEST = 64, 64, float(1 << 20)
#: Dimensions added between two looks at the best.
STEP = 8


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v of the kept vectors: floor(64 * x) of each component."""
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double")).alias("x"))
    # Not a number is greater than any number here, and a comparison with null counts as false.
    fits = (F.size("x") == DIMENSIONS) & F.forall("x", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return named.filter("x is not null").filter(fits).select("id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(-1, DIMENSIONS)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of each row, by partial sums over ``order``."""
    x, centroids = x[:, order], centroids[:, order]
    steps = [slice(s, s + STEP) for s in range(0, x.shape[1], STEP)]
    part = np.stack([((x[:, steps[0]] - c[steps[0]]) ** 2).sum(1) for c in centroids], 1)
    which = part.argmin(1)
    rows = np.arange(len(x))
    best = part[rows, which] + ((x[:, STEP:] - centroids[which, STEP:]) ** 2).sum(1)
    for k, c in enumerate(centroids):
        alive = np.flatnonzero((which != k) & (part[:, k] <= best))
        d = part[alive, k]
        for s in steps[1:]:
            if not len(alive):
                break
            d = d + ((x[alive, s] - c[s]) ** 2).sum(1)
            stay = d <= best[alive]
            alive, d = alive[stay], d[stay]
        closer = (d < best[alive]) | ((d == best[alive]) & (k < which[alive]))
        best[alive[closer]], which[alive[closer]] = d[closer], k
    return which, best


def _spread(vectors: DataFrame) -> np.ndarray:
    """The dimensions by falling variance."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, DIMENSIONS))
        for b in batches:
            x = _matrix(b).astype(np.float64)
            total += [np.full(DIMENSIONS, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), *(pa.array(t) for t in total)], ["dim", "n", "s", "q"])

    rows = vectors.select("v").mapInArrow(add, "dim long, n double, s double, q double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()
    variance = {r["dim"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in rows if r["n"]}
    return np.array(sorted(range(DIMENSIONS), key=lambda d: (-variance.get(d, 0.0), d)))


def _moved(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round."""
    sent = vectors.sparkSession.sparkContext.broadcast((np.array(centroids, np.int64), order))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, order = sent.value
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            x = _matrix(b)
            if len(x):
                which, _ = nearest(x, c, order)
                n += np.bincount(which, minlength=len(c))
                for k in np.unique(which):
                    sums[k] += x[which == k].sum(0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), DIMENSIONS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(n), lists], ["cluster", "n", "sums"])

    found = vectors.select("v").mapInArrow(add, "cluster long, n long, sums array<long>").filter("n > 0")
    total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(DIMENSIONS)]
    moved = list(centroids)
    for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        moved[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(DIMENSIONS)]
    return moved


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", seed: str = "1") -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid (its components) of every kept vector, after ``rounds`` rounds from the ``k`` vectors of smallest sha256 of ``seed:id``."""
    spark = vectors.sparkSession
    whole = common.written(integers(vectors, id_col, vector_col), "integers")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r["v"]) for r in whole.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()]
    order = _spread(whole) if centroids else np.arange(DIMENSIONS)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(whole, centroids, order)
    sent = spark.sparkContext.broadcast((np.array(centroids, np.int64).reshape(-1, DIMENSIONS), order))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, order = sent.value
        for b in batches:
            if b.num_rows:
                which, d = nearest(_matrix(b), c, order)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(which.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    placed = common.written(whole.mapInArrow(assign, f"id {dict(whole.dtypes)['id']}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    common.discard(whole)
    rows = [(c, sums[c], sum(sums.values()), centroids[c]) for c in sums]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    found = placed.join(F.broadcast(totals), "cluster")
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str) -> Column:
    """Lower-case hex sha256 of a centroid's components as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def _round(n: int) -> str:
    return f"""
a{n} AS (
  SELECT id, v, arg_min(c, (list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS c
  FROM vectors CROSS JOIN c{n - 1} GROUP BY id, v),
s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS w FROM s{n} GROUP BY c),
c{n} AS (SELECT c, coalesce(m{n}.w, c{n - 1}.w) AS w FROM c{n - 1} LEFT JOIN m{n} USING (c)),"""


ORACLE_SQL = f"""
WITH vectors AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS c, v AS w FROM vectors ORDER BY sha256('1:' || id) LIMIT 16),
{_round(1)}{_round(2)}{_round(3)}
d AS (
  SELECT id, c, w, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM vectors CROSS JOIN c3),
best AS (SELECT id, c, w, distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, c) = 1)
SELECT id AS vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM best
"""
