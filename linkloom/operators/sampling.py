"""Reproducible sampling: a row's place is ``md5(seed | id)``, the same in every engine and every retry.

The id columns must identify a row. Hex digits of the hash cut every group into even slices, and a
histogram of the slices, counted with map-side sums, tells in which slice the n-th row of a group lies.
A sample keeps the rows up to that slice before anything is shuffled, and ranks only what it kept. No
task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.aggregates import dedupe
from linkloom.functions.text import lift_inline, merge_heading_tags
from linkloom.operators.windows import equal_width_bucket, global_rank, group_count, percent_rank_average
from linkloom.schemas import CODING_SHEET
from linkloom.session import cut_lineage

#: Hex digits of a slice: 4096 slices for each group; the slice that holds the n-th row is cut once more
#: by as many digits where it has more than FINE_ROWS rows.
SLICE_DIGITS, FINE_ROWS = 3, 50_000
#: Slices are told of so many groups, the largest ones, which bounds the table that is broadcast.
MOST_GROUPS = 100_000
#: Digits of a drawn number: 60 bits.
_DRAW_DIGITS = 15


def sample_hash(seed: str | int, ids: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def hash_number(h: Column) -> Column:
    """First eight hex digits as a number, 0 .. 2**32 - 1."""
    return F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("long")


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def _hashed(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str | int) -> DataFrame:
    """Rows with their hash ``_h`` and ``_all``, a key all rows share. It is 0, but no constant to Spark, which
    would turn an equi join on it into a join of all with all."""
    hashed = _known(df, keys).withColumn("_h", sample_hash(seed, ids))
    return hashed.withColumn("_all", F.length("_h") - 32)


def _slices(hashed: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """``keys, _s, _n, _before``: rows in each slice, and in the slices before it. At most 16 ** digits rows a group."""
    counts = hashed.groupBy(*keys, F.substr("_h", F.lit(1), F.lit(digits)).alias("_s")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def sample_rank(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str | int, name: str = "rk") -> DataFrame:
    """Rank 1 .. n of every row within its group in hash order. Rows with a NULL key are left out."""
    keys, ids = list(keys), list(ids)
    hashed = _known(df, keys).withColumn("_h", sample_hash(seed, ids)).withColumn("_s", F.substr("_h", F.lit(1), F.lit(SLICE_DIGITS)))
    slices = _slices(hashed, keys, SLICE_DIGITS).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_s").orderBy("_h", *ids))
    out = hashed.join(slices, [*keys, "_s"]).withColumn(name, F.col("_before") + inside)
    return out.select(*df.columns, name)


def first_in_hash_order(
    df: DataFrame, keys: Sequence[str], n: Column | int | None, ids: Sequence[str], seed: str | int = 0
) -> DataFrame:
    """The first ``n`` rows of every group in hash order; ``n`` may be an expression over the keys, and None
    stands for the size of the smallest group. Rows with a NULL key are left out.

    Two passes over ``df``: the histogram of slices, then the selection. Rows behind the slice that holds
    a group's n-th row are dropped in the scan; the rows of slices before it all belong to the sample and
    only the last slice is ranked to its end. A last slice with more than ``FINE_ROWS`` rows is cut once more (a
    third pass, over the rows of such slices). Groups beyond the ``MOST_GROUPS`` largest ones are ranked
    whole, each by itself; they hold less than a hundred-thousandth of all rows each.
    """
    keys, ids = [*keys, "_all"], list(ids)
    hashed = _hashed(df, keys[:-1], ids, seed)
    sliced = _slices(hashed, keys, SLICE_DIGITS)
    sizes = sliced.withColumn("_size", F.sum("_n").over(W.partitionBy(*keys)))
    if n is None:
        wanted = sizes.agg(F.min("_size")).scalar()
    else:
        wanted = F.lit(n) if isinstance(n, int) else n
    sizes = sizes.withColumn("_want", wanted.cast("long"))
    last = (F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") >= F.col("_want"))
    # Of each group one row: the slice with the n-th row, or all slices where the group is smaller.
    ends = sizes.groupBy(*keys, "_size", "_want").agg(F.max(F.when(last, F.struct("_s", "_before", "_n"))).alias("_end"))
    ends = ends.orderBy(F.desc("_size"), *keys).limit(MOST_GROUPS)
    ends = ends.select(
        *keys, "_want",
        F.coalesce(F.col("_end._s"), F.when(F.col("_want") > 0, "g").otherwise("")).alias("_last"),
        F.coalesce(F.col("_want") - F.col("_end._before"), F.lit(0)).alias("_need"),
        F.coalesce(F.col("_end._n"), F.lit(0)).alias("_n"),
    )
    ends = _finer(hashed, ends, keys)
    told = hashed.join(F.broadcast(ends.drop("_n")), keys, "left")
    s = F.substr("_h", F.lit(1), F.length("_last"))
    kept = told.filter(F.col("_last").isNull() | (s <= F.col("_last")))
    # Whole slices need no rank; they are spread like the others, so that no task gets a whole group.
    own = F.when(F.col("_last").isNull(), F.lit("")).otherwise(F.substr("_h", F.lit(1), F.greatest(F.length("_last"), F.lit(SLICE_DIGITS))))
    kept = kept.withColumns({"_slice": own, "_limit": F.when(F.col("_last").isNull(), wanted).when(s == F.col("_last"), F.col("_need"))})
    rank = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("_h", *ids))
    return kept.withColumn("_rk", rank).filter(F.col("_limit").isNull() | (F.col("_rk") <= F.col("_limit"))).select(*df.columns)


def _finer(hashed: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Large last slices cut by as many digits again; without such slices Spark drops this pass when it runs."""
    coarse = ends.filter(F.col("_n") <= FINE_ROWS)
    large = ends.filter(F.col("_n") > FINE_ROWS).withColumnRenamed("_n", "_rows")
    inside = hashed.join(F.broadcast(large), list(keys)).filter(F.substr("_h", F.lit(1), F.lit(SLICE_DIGITS)) == F.col("_last"))
    counts = inside.groupBy(*keys, "_want", "_need", F.substr("_h", F.lit(1), F.lit(2 * SLICE_DIGITS)).alias("_s")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need"))
    fine = counts.filter(last).select(*keys, "_want", F.col("_s").alias("_last"), (F.col("_need") - F.col("_before")).alias("_need"), "_n")
    return coarse.unionByName(fine)


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: str | int = 0, name: str | None = None) -> DataFrame:
    """All rows in hash order; with ``name``, each row's number in that order beside it."""
    order = [sample_hash(seed, ids), *[F.col(c) for c in ids]]
    return df.orderBy(*order) if name is None else global_rank(df, order, name)


def sample_fraction(df: DataFrame, fraction: float, ids: Sequence[str], seed: str | int = 0) -> DataFrame:
    """Row-local Bernoulli sample."""
    return df.filter(hash_number(sample_hash(seed, ids)) < int(fraction * 2**32))


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: str | int = 0) -> DataFrame:
    return first_in_hash_order(df, [], n, ids, seed)


def sample_per_group(
    df: DataFrame, keys: Sequence[str], n: int, ids: Sequence[str], seed: str | int = 0
) -> DataFrame:
    return first_in_hash_order(df, keys, n, ids, seed)


def drawn_number(seed: str | int, columns: Sequence[str], size: Column) -> Column:
    """A number 1 .. size, uniform for sizes of any magnitude.

    Each hash gives two numbers of 60 bits; those at or above the largest multiple of the size are
    rejected, and the next one is taken. Eight hashes; the last one is taken modulo, which is reached
    once in 2**16 draws if the size comes near 2**60, and practically never below.
    """
    hashes = [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns], *([F.lit(str(i))] if i else []))) for i in range(8)]
    number = lambda h, at: F.conv(F.substr(h, F.lit(at), F.lit(_DRAW_DIGITS)), 16, 10).cast("long")
    numbers = [number(h, at) for h in hashes for at in (1, 1 + _DRAW_DIGITS)]
    limit = F.lit(1 << 4 * _DRAW_DIGITS) - F.pmod(F.lit(1 << 4 * _DRAW_DIGITS), size)
    fits = [F.when(x < limit, x) for x in numbers[:-1]]
    return F.pmod(F.coalesce(*fits, numbers[-1]), size) + 1


def sample_with_replacement(
    df: DataFrame, keys: Sequence[str], n: int, ids: Sequence[str], seed: str | int = 0
) -> DataFrame:
    """``n`` draws per group, repeated rows kept once.

    A draw is a rank in hash order. The histogram of slices tells the slice of every drawn rank; only the
    rows of such slices are shuffled and ranked.
    """
    keys, ids = [*keys, "_all"], list(ids)
    hashed = _hashed(df, keys[:-1], ids, seed)
    slices = cut_lineage(_slices(hashed, keys, SLICE_DIGITS))
    sizes = slices.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    draws = sizes.select(*keys, "_size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_draw"))
    draws = draws.select(*keys, drawn_number(seed, [*keys[:-1], "_draw"], F.col("_size")).alias("_rk")).distinct()
    # Each rank finds its slice in the group's row of slices: at most 4096 of them.
    rows = slices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_before", "_n", "_s"))).alias("_slices"))
    found = draws.join(rows, keys).withColumn(
        "_hit", F.get(F.filter("_slices", lambda x: (x["_before"] < F.col("_rk")) & (F.col("_rk") <= x["_before"] + x["_n"])), F.lit(0))
    )
    found = found.select(*keys, F.col("_hit._s").alias("_s"), (F.col("_rk") - F.col("_hit._before")).alias("_place"))
    picks = cut_lineage(found.groupBy(*keys, "_s").agg(F.collect_set("_place").alias("_places")))
    if picks.count() <= MOST_GROUPS:  # so few slices go to the rows, and nothing else is shuffled
        picks = F.broadcast(picks)
    asked = hashed.withColumn("_s", F.substr("_h", F.lit(1), F.lit(SLICE_DIGITS))).join(picks, [*keys, "_s"])
    place = F.row_number().over(W.partitionBy(*keys, "_s").orderBy("_h", *ids)).cast("long")
    return asked.withColumn("_place", place).filter(F.array_contains("_places", F.col("_place"))).select(*df.columns)


def sample_quotas(
    df: DataFrame, stratum: str, quotas: Mapping[int, int], ids: Sequence[str], seed: str | int = 0
) -> DataFrame:
    """``quotas[s]`` rows of stratum ``s``."""
    limit = F.lit(0)
    for value, quota in quotas.items():
        limit = F.when(F.col(stratum) == value, quota).otherwise(limit)
    return first_in_hash_order(df.filter(F.col(stratum).isin(list(quotas))), [stratum], limit, ids, seed)


def quotas_from_list(numbers: Sequence[int]) -> dict[int, int]:
    """The k-th number is the quota of count k."""
    return {k: n for k, n in enumerate(numbers, 1)}


def bucket_sample(
    df: DataFrame,
    column: str,
    buckets: int,
    n: int,
    domain: str,
    ids: Sequence[str],
    seed: str | int = 0,
) -> DataFrame:
    """``n`` rows from each popularity bucket of ``column``, at most one row per domain."""
    counted = group_count(df, [column], column, "article_count")
    ranked = percent_rank_average(counted, "article_count", "_pct")
    placed = equal_width_bucket(ranked, "_pct", buckets, "bucket").drop("_pct")
    return sample_per_group(dedupe(placed, [domain], ids), ["bucket"], n, ids, seed)


def sample_by_tag(
    df: DataFrame,
    tags: Sequence[str],
    n: int,
    domain: str,
    ids: Sequence[str],
    lift: Sequence[str] = (),
    more_than: int = 9,
    seed: str | int = 0,
) -> DataFrame:
    """``n`` draws per parent tag that has more than ``more_than`` titles, one row per domain."""
    if lift:
        df = df.withColumn("a1", merge_heading_tags(lift_inline("a1", "a2", lift)))
    df = df.filter(F.col("a1").isin(list(tags)))
    # One row per tag of the argument list: bounded by it.
    frequent = df.groupBy("a1").agg(F.count("title").alias("_n")).filter(F.col("_n") > more_than)
    kept = dedupe(df, [domain], ids).join(F.broadcast(frequent.select("a1")), "a1", "left_semi")
    return sample_with_replacement(kept.select(*df.columns), ["a1"], n, ids, seed)


def sample_contexts(
    df: DataFrame, key: str, values: Sequence[str], n: int, domain: str, ids: Sequence[str], seed: str | int = 0
) -> DataFrame:
    """Several contexts of each listed article, one per domain."""
    return sample_per_group(dedupe(df.filter(F.col(key).isin(list(values))), [domain], ids), [key], n, ids, seed)


def equal_size_sample(df: DataFrame, key: str, ids: Sequence[str], seed: str | int = 0) -> DataFrame:
    """Every group cut to the size of the smallest."""
    return first_in_hash_order(df, [key], None, ids, seed)


def head_and_tail_sample(
    df: DataFrame,
    order: str,
    ids: Sequence[str],
    head: int = 100,
    tail: int = 500,
    n: int = 60,
    seed: str | int = 0,
) -> DataFrame:
    """``n`` rows of the ``head`` largest and ``n`` of the ``tail`` smallest."""
    top = df.orderBy(F.desc(order), *ids).limit(head)
    bottom = df.orderBy(F.asc(order), *ids).limit(tail)
    one = lambda d, side: sample_n(d, n, ids, seed).withColumn("side", F.lit(side))
    return one(top, "head").unionByName(one(bottom, "tail"))


def train_test_split(df: DataFrame, ids: Sequence[str], train: float = 0.75, seed: str | int = 0) -> DataFrame:
    """Adds ``is_train``; row-local, so both parts stay the same in every run and retry."""
    return df.withColumn("is_train", hash_number(sample_hash(seed, ids)) < int(train * 2**32))


def coding_sheet(df: DataFrame, with_rank: bool = False, rank: str = "#harmonicc_pos") -> DataFrame:
    """Columns for human coders, parents under their names in the sheet."""
    sheet = df.withColumnsRenamed({"a1": "parent_1", "a2": "parent_2"})
    first, rest = CODING_SHEET[: CODING_SHEET.index("parent_1")], CODING_SHEET[CODING_SHEET.index("parent_1") :]
    return sheet.select(*first, *([f"`{rank}`"] if with_rank else []), *rest)
