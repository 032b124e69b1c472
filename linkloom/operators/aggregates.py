"""Aggregations and the statistics built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.operators.skew import attach


def counts(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sums(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], approx: bool = False) -> DataFrame:
    one = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*keys).agg(*[one(c).alias(f"n_{c}") for c in columns])


def numeric_sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of every numeric column that is not a key."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric])


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; unknown counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def normalise(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Value over the total of its group (or of the table)."""
    if not by:
        total = df.agg(F.sum(value)).scalar()
        return df.withColumn(name, F.try_divide(F.col(value), total))
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"), F.count("*").alias("_rows"))
    out = attach(df, totals, by, weight="_rows")
    return out.withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total", "_rows")


def dedupe(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order. ``row_number = 1`` is cut before the shuffle."""
    w = W.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def groups_with(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups that pass ``condition``, an aggregate predicate."""
    kept = df.groupBy(*keys).agg(condition.alias("_ok"), F.count("*").alias("_rows")).filter("_ok")
    return attach(df, kept.drop("_ok"), keys, how="inner", weight="_rows").drop("_rows")


def pearson_matrix(df: DataFrame, columns: Sequence[str], nulls: str = "complete") -> DataFrame:
    """``a, b, n, r, t`` per pair of columns, in one pass.

    ``complete`` uses rows without any NULL, ``pairwise`` all rows with both values.
    """
    if nulls == "complete":
        df = df.na.drop(subset=list(columns))
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    x = lambda c: F.col(c).cast("double")
    one = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("a"),
                    F.lit(b).alias("b"),
                    F.count_if(both(a, b)).alias("n"),
                    F.corr(x(a), x(b)).alias("r"),
                )
                for a, b in pairs
            ]
        ).alias("m")
    )
    out = one.select(F.inline("m"))
    rest = F.when(F.abs("r") < 1 - 1e-12, 1 - F.col("r") * F.col("r"))
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / rest))


def shannon_entropy(df: DataFrame, group: Sequence[str], weight: str) -> DataFrame:
    """Entropy in nats of the weights of each group, which need not add up to one.

    ``-sum p ln p`` with ``p = w / total`` is ``ln(total) - sum(w ln w) / total``: one aggregation.
    """
    w = F.col(weight).cast("double")
    total = F.sum(w)
    wlogw = F.sum(F.when(w > 0, w * F.ln(w)).otherwise(0.0))
    return df.groupBy(*group).agg((F.ln(total) - wlogw / total).alias("entropy"))


def value_entropy(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Entropy of the distribution of ``value`` within each group."""
    return shannon_entropy(counts(df, [*group, value], "_n"), group, "_n")


def cross_entropy_matrix(dist: DataFrame, columns: Sequence[str], kl: bool = False) -> DataFrame:
    """``true, estimated, score, skipped`` for each pair of distribution columns (one row per topic).

    ``-sum p ln q``, or ``sum p ln(p / q)`` with ``kl``. Topics where q is 0 are left out and counted.
    """
    p = lambda c: F.col(c).cast("double")

    def score(a: str, b: str) -> Column:
        term = F.when(p(a) > 0, p(a) * F.ln(p(a) / p(b))).otherwise(0.0) if kl else -p(a) * F.ln(p(b))
        return F.struct(
            F.lit(a).alias("true"),
            F.lit(b).alias("estimated"),
            F.sum(F.when(p(b) > 0, term)).alias("score"),
            F.count_if(p(b) == 0).alias("skipped"),
        )

    return dist.agg(F.array(*[score(a, b) for a in columns for b in columns]).alias("m")).select(F.inline("m"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """``bin`` (1 .. bins), its lower edge, and the count; the maximum belongs to the last bin."""
    x = F.col(column).cast("double")
    edges = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    placed = df.filter(F.col(column).isNotNull()).select(x.alias("_x"), edges.alias("_e"))
    number = F.when(hi > lo, F.least(F.width_bucket(F.col("_x"), lo, hi, F.lit(bins)), F.lit(bins))).otherwise(1)
    return placed.groupBy(number.cast("int").alias("bin"), (lo + (number - 1) * (hi - lo) / bins).alias("lower")).agg(
        F.count("*").alias("count")
    )


def distribution_gap(dist: DataFrame, topic: str, a: str, b: str) -> DataFrame:
    """Difference of two distribution columns and its size."""
    gap = F.col(a) - F.col(b)
    return dist.select(topic, gap.alias("gap"), F.abs(gap).alias("abs_gap"))


def extremes(df: DataFrame, topic: str, value: str, k: int = 3) -> DataFrame:
    """The ``k`` largest and the ``k`` smallest."""
    high = df.orderBy(F.desc(value), topic).limit(k).withColumn("side", F.lit("largest"))
    low = df.orderBy(F.asc(value), topic).limit(k).withColumn("side", F.lit("smallest"))
    return high.unionByName(low)


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("count"))


def pair_counts(df: DataFrame, text: str = "hypertext", target: str = "wiki_url") -> DataFrame:
    """How often each anchor text points to each target."""
    return counts(df, [text, target])
