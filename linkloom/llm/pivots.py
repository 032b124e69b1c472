"""k-means in exact integers, with a table of distances to fixed pivots (LAESA).

Each component x becomes floor(1024 * x). The vectors with the smallest hashes are the first centroids;
they and the next ones by hash are the pivots, which never move. Each vector's distance to every pivot
is computed once and stored beside it. In a round, a centroid's own distances to the pivots give a
lower bound of its distance to each vector: the largest difference of the two pivot distances. The
centroid with the least bound is measured first; only centroids whose bound does not exceed that
distance get their exact integer distance. Each task sums its vectors by centroid, Spark adds the sums,
and the driver holds the centroids alone (k x dims integers).

A vector is kept if it has exactly ``DIMS`` components, none of them null or non-finite, and none of
``LARGEST`` or more in size (squared distances would not fit a long). Other rows are left out. Rows that
repeat an id, or an id and a vector, count one by one. Rows with a null id are clustered too, but give
no first centroid while there are rows with an id. Equal hashes are ordered by the vector. With fewer
kept rows than ``K`` there are as many centroids as rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

DIMS, SCALE = 64, 1024
LARGEST = float(1 << 17)
K, ROUNDS, PIVOTS = 8, 10, 16
SEED = "3:"
BATCH_ROWS = 4096
#: Pivot distances are doubles; bounds are lowered by this share of them, so rounding excludes no centroid.
SLACK = 1e-9


def kept(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = DIMS) -> DataFrame:
    """(vec_id, x) of the vectors that are clustered, x as integers."""
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    rows = rows.filter((F.size("v") == dims) & ~wrong)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("x"))


def first_vectors(vectors: DataFrame, n: int, seed: str = SEED) -> np.ndarray:
    """The n vectors with the smallest hashes of seed and id: n rows at most reach the driver."""
    marked = vectors.withColumn("mark", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    rows = marked.orderBy(F.asc_nulls_last("mark"), "x").limit(n).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` and ``y``, pair by pair."""
    diff = x - y
    return np.einsum("ij,ij->i", diff, diff)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None]) for p in pivots], 1).astype(np.float64))


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
    of_centroids = pivot_distances(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, j, None] - of_centroids[None, :, j]), out=bound)
    reach = to_pivots.max(1)[:, None] + of_centroids.max(1)[None]
    bound = np.maximum(0.0, bound - SLACK * reach) ** 2
    best = bound.argmin(1)
    distance = squared(x, centroids[best])
    measured = len(x)
    first = best.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= distance) & (first != c))
        d = squared(x[rows], centroids[c][None])
        measured += len(rows)
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[better]], distance[rows[better]] = c, d[better]
    return best, distance, measured


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, x, p): the table of pivot distances, computed once and stored."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = shared.value
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                p = pivot_distances(_rows(part.column(1), fixed.shape[1]).astype(np.int64), fixed)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(fixed)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], ["vec_id", "x", "p"])

    return stored(vectors.select("vec_id", "x").mapInArrow(measured, "vec_id long, x array<int>, p array<double>"), "pivot-table")


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, schema: str, give: Callable[..., pa.RecordBatch]) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast((centroids, pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pivots = shared.value
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                x = _rows(part.column(1), centroids.shape[1]).astype(np.int64)
                best, distance, measured = nearest(x, _rows(part.column(2), len(pivots)), centroids, pivots)
                yield give(part.column(0), x, best, distance, measured)

    return table.mapInArrow(assign, schema)


def _sums(ids: pa.Array, x: np.ndarray, best: np.ndarray, distance: np.ndarray, measured: int) -> pa.RecordBatch:
    found = np.unique(best)
    sums = [x[best == c].sum(0).tolist() for c in found]
    n = np.bincount(best)[found]
    share = np.where(np.arange(len(found)) == 0, measured, 0)
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums, pa.list_(pa.int64())), pa.array(n), pa.array(share)], ["cluster", "s", "n", "measured"])


def _places(ids: pa.Array, x: np.ndarray, best: np.ndarray, distance: np.ndarray, measured: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])


def move(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """One round: the centroids after it, and the number of exact distances it computed. Empty centroids stay."""
    parts = _assigned(table, centroids, pivots, "cluster int, s array<long>, n long, measured long", _sums)
    facts = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *facts).collect()
    after = centroids.copy()
    for r in rows:
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return after, sum(r["measured"] for r in rows)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) of the rows ``kept`` gives."""
    first = first_vectors(vectors, max(k, pivots))
    if not len(first):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), first
    fixed, centroids = first[:pivots], first[:k]
    table = with_pivots(vectors, fixed)
    for _ in range(rounds):
        centroids, _ = move(table, centroids, fixed)
    return _assigned(table, centroids, fixed, "vec_id long, cluster int, distance long", _places), centroids


def query(embeddings: DataFrame) -> DataFrame:
    """The registered query: every kept vector with its cluster and the inertias."""
    spark = embeddings.sparkSession
    places, centroids = cluster(kept(embeddings))
    places = stored(places, "places")
    # One row for each centroid, so the table of facts is small whatever the input.
    sums = {r["cluster"]: r["s"] for r in places.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, sums.get(i, 0), sum(sums.values()), digest) for i, digest in enumerate(digests)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = places.join(F.broadcast(facts), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
