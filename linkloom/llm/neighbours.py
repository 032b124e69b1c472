"""Nearest neighbours by inner product: an inverted-file index scanned with adaptive dimension tests.

Equal vectors are indexed once, with the few smallest ids that can ever be answers. A vector gets one
more component, sqrt(M^2 - |x|^2) for the largest norm M, so that the largest inner product is the
smallest distance. Vectors are turned by a random orthogonal matrix; then the first t components tell
about the whole distance: a candidate is given up as soon as its partial distance over t of D
components, scaled by D / t, exceeds (1 + EPSILON / sqrt(t))^2 times the distance of the k-th best.
Lists of k-means centres (fitted on a bounded, documented sample) hold the vectors in blocks, stored
by columns of ``STEP`` components. Each query scans its nearest list first, whole; its k-th distance
there bounds the scans of the other lists it probes. Survivors are ranked by the inner product of the
original vectors in double precision.

Null vectors, vectors with null or non-finite components and zero vectors take no part, nor do
vectors of another dimension than most have (ties: the smaller dimension), or rows with a null id.
Rows that repeat an id and vector count once; rows with the same id and other vectors are answers of
their own. Ties go to the smaller id. With fewer than k candidates all are returned, where probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import bounded_sample, stored

K = 20
#: Rows of the k-means sample, chosen by the hash of the id.
SAMPLE_ROWS = 20_000
#: Lists are at most as many, so the centres stay small enough to broadcast.
MOST_LISTS = 2048
BLOCK_ROWS, QUERY_ROWS = 1024, 256
STEP, EPSILON = 16, 2.1
PROBE_SHARE, PROBE_LEAST = 0.8, 6


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    largest: float

    def turned(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0.0, self.largest**2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, extra[:, None]], 1) @ self.rotation

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres**2).sum(1)[None] - 2 * turned @ self.centres.T
        n = min(n, len(self.centres))
        part = np.argpartition(d, n - 1, 1)[:, :n] if n < len(self.centres) else np.tile(np.arange(n), (len(d), 1))
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1), 1)

    @property
    def probes(self) -> int:
        return max(PROBE_LEAST, int(np.ceil(PROBE_SHARE * len(self.centres))))


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, v) of the vectors that take part, as doubles."""
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.filter(fine).withColumn("v", F.transform("v", lambda x: x + 0.0))
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return own.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def fit(vectors: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 17) -> Index:
    """k-means on a bounded sample; about sqrt(n) / 4 lists, at most ``MOST_LISTS``."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("m"), F.first(F.size("v")).alias("d")).first()
    if not facts["n"]:
        return Index(np.zeros((0, 1)), np.eye(1), 0.0)
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.standard_normal((facts["d"] + 1, facts["d"] + 1)))[0]
    index = Index(np.zeros((0, 1)), rotation, facts["m"] * (1 + 1e-12))
    sample = bounded_sample(vectors, "id", rows).select("v").toPandas()["v"]
    lists = min(MOST_LISTS, max(1, int(np.sqrt(facts["n"]) / 4)))
    x = np.stack(sample.to_list()) if len(sample) else np.zeros((1, facts["d"]))
    x = index.turned(x, False)
    centres = x[random.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(8):
        index.centres = centres
        of = np.concatenate([index.nearest(part, 1)[:, 0] for part in np.array_split(x, max(1, len(x) // 2048))])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    index.centres = centres
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scan(columns: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row of the block) whose distance may be within the query's bound.

    ``columns`` is components x rows, ``queries`` is queries x components. While many pairs are left, a
    block of components is added for all of them at once, then for the remaining pairs alone.
    """
    dims = queries.shape[1]
    partial = np.zeros((len(queries), columns.shape[1]))
    keep, pairs = np.ones(partial.shape, bool), None
    for at in range(0, dims, STEP):
        to = min(dims, at + STEP)
        factor = 1 + 1e-9 if to == dims else to / dims * (1 + EPSILON / np.sqrt(to)) ** 2
        limit = bounds * factor + 1e-9
        if pairs is None:
            c, q = columns[at:to], queries[:, at:to]
            partial += (c**2).sum(0)[None] + (q**2).sum(1)[:, None] - 2 * (q @ c)
            keep &= partial <= limit[:, None]
            if keep.sum() < 0.1 * keep.size:
                pairs = np.nonzero(keep)
                partial = partial[pairs]
        else:
            diff = columns[at:to][:, pairs[1]] - queries.T[at:to][:, pairs[0]]
            partial = partial + (diff**2).sum(0)
            left = partial <= limit[pairs[0]]
            pairs, partial = (pairs[0][left], pairs[1][left]), partial[left]
    return np.nonzero(keep) if pairs is None else pairs


def _scores(own: np.ndarray, vectors: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if len(pairs[0]) > 0.1 * len(own) * len(vectors):
        return (own @ vectors.T)[pairs]
    return np.einsum("ij,ij->i", own[pairs[0]], vectors[pairs[1]])


def _best(query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best scores; ties by the smallest id of the vector."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def search(vectors: DataFrame, asked: DataFrame, index: Index, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ids in ``asked``; both frames come from ``usable``."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    # One row for each different vector: no more than k + 1 ids of it can be answers.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = vectors.distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
    unique = members.groupBy("v").agg(F.min("id").alias("u"), F.sort_array(F.collect_list("id")).alias("ids"))
    unique = stored(unique, "vectors")
    queries = asked.select("id", "v").distinct()
    q_unique = stored(queries.groupBy("v").agg(F.min("id").alias("q")), "query-vectors")

    def lists(query: bool):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.slice(at, 2048)
                    if not len(part):
                        continue
                    turned = index.turned(_matrix(part.column(1)), query)
                    near = index.nearest(turned, index.probes if query else 1)
                    n, width = near.shape
                    rows = np.repeat(np.arange(n), width)
                    table = pa.table({"id": part.column(0), "v": part.column(1)}).take(pa.array(rows)).combine_chunks()
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(turned[rows].ravel()), turned.shape[1]).cast(pa.list_(pa.float64()))
                    arrays = [table.column(0).chunk(0), table.column(1).chunk(0), flat, pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), n))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "v", "t", "list", "place"])

        return assign

    kind = "id long, v array<double>, t array<double>, list int, place int"
    indexed = unique.select(F.col("u").alias("id"), "v").mapInArrow(lists(False), kind)
    # Lists are cut in blocks of bounded size, and the queries of a list in groups of bounded size.
    sizes = stored(indexed, "lists")
    n = sizes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # one row for each list
    blocks = sizes.join(F.broadcast(n), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = blocks.groupBy("list", "block").agg(F.collect_list(F.struct("id", "v", "t")).alias("rows"))
    blocks = stored(blocks, "blocks")

    probes = stored(q_unique.select(F.col("q").alias("id"), "v").mapInArrow(lists(True), kind), "probes")

    def round_of(asked: DataFrame) -> DataFrame:
        n = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
        asked = asked.join(F.broadcast(n), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        asked = asked.groupBy("list", "part").agg(F.collect_list(F.struct("id", "v", "t", "bound")).alias("asked"))
        return blocks.join(asked, "list").select("rows", "asked").mapInArrow(scanned, "q long, u long, score double, d double")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, queries = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                ids = rows.field("id").to_numpy()
                vectors, columns = _matrix(rows.field("v")), np.ascontiguousarray(_matrix(rows.field("t")).T)
                own, turned = _matrix(queries.field("v")), _matrix(queries.field("t"))
                bounds = queries.field("bound").to_numpy(zero_copy_only=False)
                asked = queries.field("id").to_numpy()
                pairs = scan(columns, turned, bounds)
                scores = _scores(own, vectors, pairs)
                best = _best(pairs[0], scores, ids[pairs[1]], k + 1)
                q, r = pairs[0][best], pairs[1][best]
                distance = ((columns[:, r] - turned[q].T) ** 2).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[r]), pa.array(scores[best]), pa.array(distance)], ["q", "u", "score", "d"])

    def cut(found: DataFrame) -> DataFrame:
        """The k + 1 best different vectors of each query vector are enough, its own included."""
        order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "u"))
        return found.withColumn("r", order).filter(F.col("r") <= k + 1)

    near = stored(cut(round_of(probes.filter("place = 0").withColumn("bound", F.lit(float("inf"))))), "nearest-list")
    reach = near.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    reach = reach.select(F.col("q").alias("id"), F.when(F.col("n") > k, F.col("d")).otherwise(float("inf")).alias("bound"))
    others = probes.filter("place > 0").join(reach, "id", "left").fillna(float("inf"), ["bound"])
    found = near.select("q", "u", "score").unionByName(round_of(others).select("q", "u", "score"))
    found = cut(found.withColumn("d", F.lit(0.0))).select("q", "u", "score")
    # Back to rows: the ids of each found vector, for every id that asked with this vector.
    answers = found.join(unique.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    answers = answers.withColumn("r", order).filter(F.col("r") <= k + 1)
    asks = queries.join(q_unique, "v").select(F.col("id").alias("query_id"), "q")
    out = asks.join(answers, "q").filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    """The registered query: rows whose id is divisible by 20 against all others."""
    vectors = stored(usable(embeddings), "usable")
    return search(vectors, vectors.filter(F.col("id") % 20 == 0), fit(vectors))
