"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one row in HOT_SPLITS. There can be at most HOT_SPLITS such
# keys, whatever the data, which is the size bound of everything broadcast here.
HOT_SPLITS = 1000
_SPREAD = 1024


def _no_null(keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def attach(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    splits: int = HOT_SPLITS,
) -> DataFrame:
    """Join ``facts`` (one row per key) onto ``df``.

    Rows of hot keys find their facts in a broadcast of the hot keys alone (at most ``splits`` rows)
    and are spread evenly over the shuffle, as are rows with a NULL key, which match nothing. All
    other rows go through an ordinary equi join. ``weight`` names a column of ``facts`` that already
    holds the number of ``df`` rows per key; without it the rows are counted.
    """
    keys = list(keys)
    values = [c for c in facts.columns if c not in keys]
    facts = facts.filter(_no_null(keys))
    if weight is None:
        counts = df.filter(_no_null(keys)).groupBy(*keys).agg(F.count("*").alias("_rows"))
        total = counts.agg(F.sum("_rows")).scalar()
        hot_keys = counts.filter(F.col("_rows") * splits > total).select(*keys)
        hot = facts.join(F.broadcast(hot_keys), keys, "left_semi")
    else:
        hot = facts.filter(F.col(weight) * splits > facts.agg(F.sum(weight)).scalar())
    found = F.struct(*values)
    hot = hot.select(*keys, found.alias("_hot"))
    cold = facts.select(*keys, found.alias("_cold"), F.lit(0).cast("long").alias("_slot"))
    slot = F.when(
        F.col("_hot").isNotNull() | ~_no_null(keys),
        F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)) + 1,
    ).otherwise(F.lit(0).cast("long"))
    out = df.join(F.broadcast(hot), keys, "left").withColumn("_slot", slot)
    out = out.join(cold, [*keys, "_slot"], "left").withColumn("_fact", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.filter(F.col("_fact").isNotNull())
    elif how != "left":
        raise ValueError("attach supports left and inner joins")
    return out.select(*df.columns, *[F.col(f"_fact.{v}").alias(v) for v in values])


def attach_rows(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``attach`` for dimensions with several rows per key (an article and its topics): a key with n facts
    gives n rows.

    A plain equi join: Spark broadcasts small facts, and adaptive execution splits the partitions of hot
    keys, so nothing of a key is gathered in one row.
    """
    if how not in ("left", "inner"):
        raise ValueError("attach_rows supports left and inner joins")
    values = [c for c in facts.columns if c not in keys]
    return df.join(facts.filter(_no_null(list(keys))), list(keys), how).select(*df.columns, *values)
