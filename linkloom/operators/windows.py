"""Group statistics beside each row, ranks and buckets.

A window over an unbounded group puts the group into one task. Group statistics are therefore
aggregated (with map-side partial sums) and attached; a rank over a whole table is the row's place in its
range partition and the number of rows in the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.skew import attach
from linkloom.session import cut_lineage

#: ``monotonically_increasing_id`` counts a partition's rows below this bit and the partitions above it.
_ROW_BITS = 33


def group_count(df: DataFrame, keys: Sequence[str], column: str | None = None, name: str = "group_count") -> DataFrame:
    """Non-NULL values of ``column`` (or rows) per group, beside each row."""
    stats = df.groupBy(*keys).agg(
        F.count(column if column else "*").alias(name), F.count("*").alias("_rows")
    )
    return attach(df, stats, keys, weight="_rows").drop("_rows")


def group_share(df: DataFrame, value: str, by: Sequence[str], name: str = "p") -> DataFrame:
    from linkloom.operators.aggregates import normalise

    return normalise(df, value, by, name)


def z_score(df: DataFrame, value: str, by: Sequence[str], name: str = "z") -> DataFrame:
    """Distance from the group's mean in sample standard deviations; NULL for groups without spread."""
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.count("*").alias("_rows")
    )
    out = attach(df, stats, by, weight="_rows")
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))
    return out.withColumn(name, z).drop("_mean", "_std", "_rows")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per group; Spark cuts each task's rows to ``n`` before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows sorted over the whole table, with their range partition ``_part`` and place in it, ``_place`` from 0.

    Spark cuts the ranges from a sample of the rows, as many as the shuffle has partitions. The result is
    kept in the shared folder: the partition of a row must be the same in all that reads it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = cut_lineage(ranged)
    return kept.withColumns({"_part": F.shiftright("_id", _ROW_BITS), "_place": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_id")


def _before_part(ranged: DataFrame, weight: Column) -> DataFrame:
    """``_part, _before``: the weight in all partitions before. One row for each partition, so the window
    without a key and the broadcast are as small as the number of partitions."""
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Number 1 .. n of each row in the order of the whole table, rows in that order.

    Give the order a tie-break (an id): only then are numbers the same in every run, and only then can a
    value that very many rows share be split over several partitions.
    """
    ranged = in_ranges(df, order)
    placed = ranged.join(_before_part(ranged, F.lit(1)), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1)
    return placed.select(*df.columns, name)


def percent_rank_average(df: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """Rank over row count, ties at their average rank. NULL values get NULL.

    Ranks are computed on distinct values with their counts, so a value that half of all rows share is
    one row. Those go to range partitions; the rows below a value are the counts before it in its
    partition, and those of the partitions before.
    """
    vals = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_ties"))
    ranged = in_ranges(vals, [value])
    inside = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranged.join(_before_part(ranged, F.col("_ties")), "_part").withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("_ties").over(inside), F.lit(0))
    )
    total = ranged.agg(F.sum("_ties")).scalar()
    pct = (F.col("_below") + (F.col("_ties") + 1) / 2) / total
    return attach(df, ranked.select(value, pct.alias(name), "_ties"), [value], weight="_ties").drop("_ties")


def equal_width_bucket(df: DataFrame, value: str, k: int, name: str = "bucket") -> DataFrame:
    """``k`` right-closed bins over the value range, numbered from 0; the minimum is in bin 0."""
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    out = df.withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / k
    number = F.ceil(F.try_divide(F.col(value) - F.col("_e.lo"), width)) - 1
    bucket = F.greatest(F.lit(0), F.least(F.lit(k - 1), F.coalesce(number, F.lit(0))))
    return out.withColumn(name, F.when(F.col(value).isNotNull(), bucket).cast("int")).drop("_e")
