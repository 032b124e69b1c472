"""Near-duplicate vectors by spherical-cap filters of random product codes.

A random rotation turns each unit vector and cuts it in ``PARTS`` parts; each part has random
directions, and every choice of one direction for each part is a filter: a cap around the concatenated
directions. Each vector is list-decoded to all filters whose inner product with it reaches a threshold:
directions that the best of the other parts cannot lift over it are left out at once, then partial sums
are cut in the same way. ``CODES`` codes are used side by side, so that no vector depends on one
rotation. The number of filters grows with the vectors: a filter holds about ``MEMBERS`` unrelated
vectors at any size. The thresholds come from random pairs at exactly the asked cosine, of which
``RECALL`` must share a filter (closer pairs share one more often); by the rotations every pair of
vectors is such a random pair.

Vectors that share a filter meet twice. First as bytes, each with the length of its rounding error: only
vectors that could have a partner go on, for certain none is lost. Those are compared by cosine in
double precision. Equal vectors are compared once, with their number as weight. In filters with more
than ``BLOCK_ROWS`` members, vectors within half the angle of one of the filter's pivots form a core: by
the triangle inequality all pairs of a core link, so they are counted and joined without a comparison.
The rest of such a filter is dealt in blocks, one run of rows for each pair of blocks. No pair of vectors
ever becomes a row: a run gives for each vector the weight of the partners found there, and its
component within the run. A pair that shares several filters counts in the first of them.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors
link only with vectors of the same length. Rows that repeat an id and vector are one vector and give
one row. Rows with one id and other vectors are vectors of their own, and so are those with a null id;
``component_id`` is the smallest id that is not null. ``kept`` holds for one vector of each component,
the first with the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stored
from linkloom.llm.components import components
from linkloom.operators.skew import attach

LEAST_COSINE = 0.95
CODES, PARTS, MEMBERS, RECALL = 16, 2, 64, 0.98
#: Random pairs that fix a threshold.
TRIALS = 1500
BLOCK_ROWS, SAMPLE_ROWS, PIVOTS = 1024, 64, 8
#: Vectors are decoded so many at a time.
DECODE_ROWS = 512
#: The number of a filter: the length of the vectors, the code, the directions.
CODE_BITS, LENGTH_BITS = 36, 40


class Code:
    """The filters of one rotation, for vectors of one length."""

    def __init__(self, dims: int, vectors: int, cosine: float, recall: float, seed: int) -> None:
        random = np.random.default_rng([29, seed, dims])
        self.rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0]
        self.parts: list[np.ndarray] = []
        sizes = [len(p) for p in np.array_split(np.arange(dims), min(PARTS, dims))]
        # About one filter of each code is passed by a vector.
        each = max(4, int(np.ceil((max(vectors, 1) / MEMBERS) ** (1 / len(sizes)))))
        for size in sizes:
            directions = random.standard_normal((each, size)) if size > 1 else np.array([[1.0], [-1.0]])
            directions /= np.linalg.norm(directions, axis=1)[:, None]
            self.parts.append(directions * np.sqrt(size / dims))
        self.threshold = self._fitted(random, cosine, recall)

    def products(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned, at, out = vectors @ self.rotation, 0, []
        for directions in self.parts:
            out.append(turned[:, at : at + directions.shape[1]] @ directions.T)
            at += directions.shape[1]
        return out

    def _fitted(self, random: np.random.Generator, cosine: float, recall: float) -> float:
        """The threshold that ``recall`` of random pairs pass with one filter in common."""
        dims = len(self.rotation)
        x = random.standard_normal((TRIALS, dims))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = random.standard_normal((TRIALS, dims))
        y -= (x * y).sum(1)[:, None] * x
        norm = np.linalg.norm(y, axis=1)[:, None]
        y = cosine * x + np.sqrt(1 - cosine**2) * np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-9)
        # The few best directions of each part for the sum of a pair hold the best filter of both, or one almost as good.
        reach = np.zeros((TRIALS, 1)), np.zeros((TRIALS, 1))
        for a, b in zip(self.products(x), self.products(y)):
            best = np.argsort(-(a + b), 1)[:, :8]
            reach = tuple((r[:, :, None] + np.take_along_axis(p, best, 1)[:, None]).reshape(TRIALS, -1) for r, p in zip(reach, (a, b)))
        return float(np.quantile(np.minimum(*reach).max(1), 1 - recall)) - 1e-9

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters each row reaches."""
        products = self.products(vectors)
        most = np.stack([p.max(1) for p in products])
        rest = most.sum(0)
        rows, number, partial = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        left = rest.copy()
        for p, top in zip(products, most):
            of, choice = np.nonzero(p >= (self.threshold - rest + top)[:, None])
            n = np.bincount(of, minlength=len(vectors))
            starts = np.cumsum(n) - n
            times = n[rows]
            back = np.repeat(np.arange(len(rows)), times)
            place = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times) + starts[rows][back]
            left = left - top
            sums = partial[back] + p[of[place], choice[place]]
            fits = sums + left[rows[back]] >= self.threshold
            rows, number, partial = rows[back[fits]], (number[back] * p.shape[1] + choice[place])[fits], sums[fits]
        return rows, number


def codes_for(dims: int, vectors: int, cosine: float) -> list[Code]:
    """``CODES`` codes that together find ``RECALL`` of the pairs at the cosine."""
    each = 1 - (1 - RECALL) ** (1 / CODES)
    return [Code(dims, vectors, cosine, each, seed) for seed in range(CODES)]


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def unique_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(id, v): the distinct rows, ids null or not; and (u, v, w, least) of the distinct vectors that can link,
    u a number of its own, w the number of their rows, least their smallest id."""
    kind = dict(embeddings.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector).cast(kind), lambda x: x + zero).alias("v"))
    rows = stored(rows.distinct(), "vectors")
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    fine = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~wrong)
    unique = fine.groupBy("v").agg(F.count("*").alias("w"), F.min("id").alias("least"))
    return rows, stored(unique.withColumn("u", F.monotonically_increasing_id()), "unique-vectors")


def decoded(unique: DataFrame, cosine: float) -> DataFrame:
    """(u, w, v, filters, bytes, error): each vector with the sorted numbers of its filters, and its unit vector
    in bytes with the length of what rounding took."""
    sizes = {r["d"]: r["n"] for r in unique.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    codes: dict[int, list[Code]] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                if dims not in codes:
                    codes[dims] = codes_for(dims, sizes[dims], cosine)
                rows = np.flatnonzero(lengths == dims)
                for at in range(0, len(rows), DECODE_ROWS):
                    part = batch.take(pa.array(rows[at : at + DECODE_ROWS]))
                    x = _unit(part.column(2), dims)
                    found = [(r, n + (i << CODE_BITS) + (dims << LENGTH_BITS)) for i, code in enumerate(codes[dims]) for r, n in [code.decode(x)]]
                    row, number = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    by = np.lexsort((number, row))
                    offsets = np.searchsorted(row[by], np.arange(len(part) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[by]))
                    scale = np.abs(x).max(1)[:, None] / 127
                    small = np.rint(x / scale).astype(np.int8)
                    error = np.sqrt(((x - small * scale) ** 2).sum(1))
                    sketch = [s.tobytes() for s in np.concatenate([scale.astype("<f8").view(np.int8), small], 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(sketch, pa.binary()), pa.array(error)], ["u", "w", "v", "filters", "bytes", "error"])

    kind = dict(unique.dtypes)["v"]
    return stored(unique.select("u", "w", "v").mapInArrow(decode, f"u long, w long, v {kind}, filters array<long>, bytes binary, error double"), "decoded")


def by_run(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows with equal values in the first ``keys`` columns; batches come sorted by them."""
    held: list[pa.RecordBatch] = []
    key: tuple[int, ...] = ()
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(c).to_numpy() for c in range(keys)], 1)
        at = 0
        for to in np.append(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, len(values)).tolist():
            here = tuple(values[at].tolist())
            if here != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key = [], here
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield key, pa.Table.from_batches(held)


def possible(rows: pa.Table, cosine: float) -> np.ndarray:
    """Rows of a filter that may link with another one, by bytes and errors: |x.y - x'.y'| <= e + e' + e e'."""
    raw = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.int8).reshape(len(rows), -1)
    x = raw[:, 8:].astype(np.float32) * np.ascontiguousarray(raw[:, :8]).view("<f8").astype(np.float32)
    error = rows["error"].to_numpy()
    reach = x @ x.T + (error[:, None] + error[None] + error[:, None] * error[None] + 1e-5)
    np.fill_diagonal(reach, -2)
    return np.flatnonzero(reach.max(1) >= cosine)


def greedy_pivots(x: np.ndarray, cosine: float, most: int = PIVOTS) -> np.ndarray:
    """Directions that cover the unit rows: the row with most others in its cap, moved to their mean; repeated on the rest."""
    half, found = np.sqrt((1 + cosine) / 2), []
    while len(x) > 1 and len(found) < most:
        near = x @ x.T >= half
        at = near.sum(1).argmax()
        if near[at].sum() < 2:
            break
        mean = x[near[at]].mean(0)
        mean /= np.linalg.norm(mean)
        covered = x @ mean >= half
        if covered.sum() < near[at].sum():
            mean, covered = x[at], near[at]
        found.append(mean)
        x = x[~covered]
    return np.array(found).reshape(len(found), x.shape[1])


def cores(members: DataFrame, cosine: float) -> DataFrame:
    """(u, core) for vectors of large filters within half the angle of a pivot; a vector has the smallest such core.

    ``members`` has (f, u, v). Pivots of a filter come from ``SAMPLE_ROWS`` of its members, chosen by hash:
    they only decide which pairs need no comparison, not which pairs link.
    """
    place = F.row_number().over(Window.partitionBy("f").orderBy(F.xxhash64("u", "f"), "u"))
    sample = members.withColumn("place", place).filter(F.col("place") <= SAMPLE_ROWS).groupBy("f").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("rows"))
    half = np.cos(np.arccos(cosine) / 2) + 1e-9

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = rows.values.field("v")
                found = greedy_pivots(_unit(v, len(v[0])), cosine)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))], ["f", "p"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs = batch.column(1).to_numpy()
            for f in np.unique(fs):
                part = batch.take(pa.array(np.flatnonzero(fs == f)))
                p = np.array(part.column(3)[0].as_py())
                inside = _unit(part.column(2), p.shape[1]) @ p.T >= half
                rows = np.flatnonzero(inside.any(1))
                core = inside[rows].argmax(1) + PIVOTS * np.int64(f)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(core)], ["u", "core"])

    found = stored(sample.mapInArrow(pivots, "f long, p array<array<double>>").filter(F.size("p") > 0), "pivots")
    inside = members.join(found, "f").select("u", "f", "v", "p").mapInArrow(nearest, "u long, core long")
    return stored(inside.groupBy("u").agg(F.min("core").alias("core")), "cores")


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each of n rows by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _earlier(f: int, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether a row of the left and one of the right share a filter before ``f``."""
    def of(rows: list[np.ndarray]) -> dict[int, list[int]]:
        held: dict[int, list[int]] = {}
        for i, filters in enumerate(rows):
            for g in filters[filters < f].tolist():
                held.setdefault(g, []).append(i)
        return held

    seen = np.zeros((len(left), len(right)), bool)
    there = of(right)
    for g, rows in of(left).items():
        if g in there:
            seen[np.ix_(rows, there[g])] = True
    return seen


def compare(f: int, rows: pa.Table, within: bool, cosine: float) -> pa.RecordBatch | None:
    """Partners found among the rows of one block (``within``) or between its two blocks: (u, links, label)."""
    x = _unit(rows["v"].combine_chunks(), len(rows["v"][0]))
    u, w = rows["u"].to_numpy(), rows["w"].to_numpy()
    core, side = rows["core"].to_numpy(), rows["side"].to_numpy()
    left = np.arange(len(u)) if within else np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    pairs = []
    near = x[left] @ x[right].T >= cosine - 1e-9
    near &= (core[left][:, None] != core[right][None]) | (core[left] < 0)[:, None]
    if within:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    # The product may round otherwise than the sum over one pair; pairs at the limit are summed again.
    exact = np.einsum("ij,ij->i", x[left[i]], x[right[j]]) >= cosine
    i, j = i[exact], j[exact]
    filters = [np.asarray(v.values) for v in rows["filters"].combine_chunks()] if len(i) else []
    if not len(i):
        return None
    some_i, some_j = np.unique(i), np.unique(j)
    seen = _earlier(f, [filters[k] for k in left[some_i]], [filters[k] for k in right[some_j]])
    fresh = ~seen[np.searchsorted(some_i, i), np.searchsorted(some_j, j)]
    a, b = left[i], right[j]
    links = np.bincount(a[fresh], w[b[fresh]], len(u)) + np.bincount(b[fresh], w[a[fresh]], len(u))
    label = _labels(a, b, len(u))
    touched = np.unique(np.concatenate([a, b]))
    return pa.RecordBatch.from_arrays([pa.array(u[touched]), pa.array(links[touched].astype(np.int64)), pa.array(u[label[touched]])], ["u", "links", "label"])


def links(unique: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(u, links, label): for parts of the comparisons, the weight of the vectors that ``u`` links with there and
    one vector it is connected with. Sums over u give all links between different vectors."""
    marked = decoded(unique, cosine)
    one = marked.select("u", F.explode("filters").alias("f"))
    large = stored(one.groupBy("f").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK_ROWS).select("f"), "large-filters")
    vectors = marked.select("u", "w", "v", "filters")
    members = stored(one.join(large, "f").join(vectors, "u").select("f", *vectors.columns), "members")
    core = cores(members.select("f", "u", "v"), cosine)
    nothing = F.lit(-1).cast("long")

    # Small filters: one run for each. Only vectors that the bytes let through are compared.
    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f,), rows in by_run(batches, 1):
            if len(rows) > 1:
                u = rows["u"].to_numpy()[possible(rows, cosine)]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.full(len(u), f))], ["u", "f"])

    small = marked.select(F.explode("filters").alias("f"), "u", "bytes", "error").join(large, "f", "left_anti")
    alive = small.repartition("f").sortWithinPartitions("f").mapInArrow(screened, "u long, f long")
    small = stored(alive, "alive").join(vectors.join(core, "u", "left"), "u")
    zero = F.lit(0)
    small = small.select("f", zero.alias("lo"), zero.alias("hi"), zero.alias("side"), F.coalesce("core", nothing).alias("core"), *vectors.columns)

    # Large ones: cells by core, cells in blocks, one run for each pair of blocks.
    dealt = members.join(core, "u", "left").withColumn("core", F.coalesce("core", nothing))
    cells = dealt.groupBy("f", "core").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    before = Window.partitionBy("f").orderBy("core").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    cells = stored(cells.withColumn("all", F.sum("blocks").over(Window.partitionBy("f")).cast("int")), "cells")
    dealt = attach(dealt, cells, ["f", "core"]).withColumn("block", F.col("start") + F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("all") - 1)
    # A core's blocks meet no block of the same core; the other vectors' blocks meet all blocks.
    same = (F.col("core") >= 0, F.col("start"), F.col("start") + F.col("blocks"))
    others = F.filter(every, lambda b: ~same[0] | (b < same[1]) | (b >= same[2]))
    dealt = dealt.withColumn("other", F.explode(others))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("f", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), side, "core", *vectors.columns)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, lo, hi), rows in by_run(batches, 3):
            found = compare(f, rows, lo == hi, cosine) if len(rows) > 1 else None
            if found is not None:
                yield found

    runs = small.unionByName(dealt).repartition("f", "lo", "hi").sortWithinPartitions("f", "lo", "hi")
    found = runs.mapInArrow(compared, "u long, links long, label long")
    # Pairs within a core link without a comparison; its smallest vector stands for it.
    weighed = core.join(unique.select("u", "w"), "u")
    sums = weighed.groupBy("core").agg(F.sum("w").alias("all"), F.min("u").alias("label"))
    within = attach(weighed, sums, ["core"]).select("u", (F.col("all") - F.col("w")).alias("links"), "label")
    return found.unionByName(within)


def groups(embeddings: DataFrame, cosine: float = LEAST_COSINE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector: its id, its number of links, the smallest id of its component, and whether it is kept."""
    rows, unique = unique_vectors(embeddings, vector, key)
    found = stored(links(unique, cosine), "links")
    near = found.groupBy("u").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("u").alias("a"), F.col("label").alias("b")), "vector-edges")
    own = unique.join(component.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    own = own.join(near, "u", "left").select("u", "v", "w", "least", "component", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = stored(own, "linked")
    # The smallest id that is not null, and the first vector that has it.
    best = own.groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("u"))).alias("best"))
    best = best.select("component", F.col("best.least").alias("component_id"), F.col("best.u").alias("first"))
    own = attach(own, best, ["component"]).select("u", "v", "w", "n_links", "component_id", "first")
    out = attach(rows, own, ["v"])
    alone = F.col("u").isNull()
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, True).otherwise(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("u") == F.col("first"))).alias("kept"),
    )


def query(embeddings: DataFrame) -> DataFrame:
    """The registered query: all rows of the table, linked from a cosine of 0.95."""
    return groups(embeddings)
