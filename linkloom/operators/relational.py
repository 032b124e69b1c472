"""Projection, reshaping, set operations, and joins beyond the plain DataFrame calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.defaults import ORDER_NAMES
from linkloom.functions import urls as U
from linkloom.operators.skew import attach
from linkloom.operators.windows import in_ranges


# --- projection and null handling ----------------------------------------------------------------
def project(df: DataFrame, spec: Mapping[str, str | Column]) -> DataFrame:
    """``{new name: column or old name}`` in the given order."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in spec.items()])


def row_sum(columns: Sequence[str | Column]) -> Column:
    """Sum across columns, NULL counted as zero."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])


def at_least(c: str, low: float, kind: str = "int") -> Column:
    """Cast-and-compare that drops text which is no number instead of failing."""
    return F.col(c).try_cast(kind) >= low


def first_order_class(link: str = "wiki_link", parent: str = "a1") -> Column:
    """Attribution, evidence, or plain web sharing (``ws``)."""
    return (
        F.when(U.is_attribution(link) == 1, "attribution").when(F.col(parent) == "cite", "evidence").otherwise("ws")
    )


def map_to_columns(df: DataFrame, map_col: str, names: Sequence[str]) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != map_col],
        *[F.try_element_at(map_col, F.lit(n)).alias(n) for n in names],
    )


# --- arrays and reshaping ------------------------------------------------------------------------
def explode_links(df: DataFrame, links: str, name: str = "wiki_link", outer: bool = False) -> DataFrame:
    gen = F.explode_outer if outer else F.explode
    return df.select(*[c for c in df.columns if c != links], gen(links).alias(name))


def zip_explode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Align parallel arrays and give one row per position."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.arrays_zip(*columns)))


def pivot_matrix(df: DataFrame, row: str, col: str, value: Column, values: Sequence) -> DataFrame:
    """Long to wide. The column values are an argument, so no extra job has to collect them."""
    return df.groupBy(row).pivot(col, list(values)).agg(value)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def concat_text_by_group(
    df: DataFrame, key: str, text: str, order: str, sep: str = " ", part_bytes: int = 16 << 20
) -> DataFrame:
    """All texts of a group in order, in numbered parts: ``key, part, text``.

    A text belongs to part k if the texts of its group before it, separators not counted, have k *
    ``part_bytes`` bytes or more, and fewer than (k + 1) * ``part_bytes``. So a part holds at most
    ``part_bytes`` and one more text, whatever the order values are: equal and missing ones are put in
    the order of the texts, missing ones first. Rows without a text are left out. Groups are spread over
    range partitions; the bytes before a row are those in its partition and in the group's partitions before.
    To count words per class use ``class_tf_idf``, which needs no such text.
    """
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).alias("_text"))
    ranged = in_ranges(rows, ["_key", "_order", "_text"]).withColumn("_bytes", F.octet_length("_text").cast("long"))
    inside = W.partitionBy("_part", "_key").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition a group has rows in.
    sums = ranged.groupBy("_key", "_part").agg(F.sum("_bytes").alias("_n"))
    sums = sums.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    placed = placed.join(sums, [placed["_key"].eqNullSafe(sums["_key"]), placed["_part"] == sums["_part"]]).select(
        placed["_key"], placed["_part"], "_place", "_text", F.floor((F.col("_before") + F.col("_inside")) / part_bytes).alias("part")
    )
    items = F.array_sort(F.collect_list(F.struct("_part", "_place", "_text")))
    joined = F.array_join(F.transform(items, lambda s: s["_text"]), sep)
    return placed.groupBy("_key", "part").agg(joined.alias(text)).withColumnRenamed("_key", key)


# --- sets ------------------------------------------------------------------------------------------
def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all(frames).distinct()


def difference_by_key(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


# --- joins -----------------------------------------------------------------------------------------
def merge_totals(frames: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add up snapshots that share keys: union and one aggregation instead of a chain of outer joins."""
    return union_all(frames).groupBy(*keys).agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(v) for v in values])


def resume_remaining(todo: DataFrame, done: DataFrame, key: str, above_max: bool = False) -> DataFrame:
    """Rows whose id is not done yet; optionally only ids above the largest one done (all, if none is)."""
    left = todo.join(done.select(key), key, "left_anti")
    if above_max:
        largest = done.agg(F.max(key)).scalar()
        left = left.filter(largest.isNull() | (F.col(key) > largest))
    return left


def order_names(spark) -> DataFrame:
    """The three region names as an inline dimension."""
    return spark.createDataFrame([(k, v) for k, v in sorted(ORDER_NAMES.items())], "`order` int, name_ string")


def with_order_names(df: DataFrame, order: str = "order") -> DataFrame:
    names = order_names(df.sparkSession).withColumnRenamed("order", order)
    return df.join(F.broadcast(names), order)


def suffix_rules(lines: DataFrame, rule: str = "rule") -> DataFrame:
    """(ending, kind) of a public suffix list in its text form, one rule a row.

    ``kind`` is ``plain``, ``wildcard`` (``*.`` before the ending) or ``exception`` (``!``). A line ends at
    its first blank; empty lines and ``//`` comments are no rules; case does not matter.
    """
    text = F.lower(F.regexp_extract(rule, r"^\s*(\S+)", 1))
    kind = F.when(text.startswith("!"), "exception").when(text.startswith("*."), "wildcard").otherwise("plain")
    rules = lines.filter((text != "") & ~text.startswith("//"))
    return rules.select(F.regexp_replace(text, r"^(?:!|\*\.)", "").alias("ending"), kind.alias("kind")).distinct()


def registered_domain_by_table(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """``domain`` and ``suffix`` per row, from a rule table ``(ending, kind)`` of any size.

    Hosts are reduced to distinct ones first. Their endings meet the rules in one equi join; an exception
    gives the ending without its first label and wins, a wildcard gives the ending one label longer, and
    among the others the longest counts. The results are attached to the rows.
    """
    hosted = df.withColumn("_host", U.host(url))
    hosts = hosted.groupBy("_host").agg(F.count("*").alias("_rows"))
    asked = hosts.withColumn("_all", U.host_endings("_host"))
    asked = asked.select("_host", "_rows", "_all", F.posexplode("_all").alias("_i", "ending"))
    longer, shorter = F.get("_all", F.col("_i") - 1), F.get("_all", F.col("_i") + 1)
    asked = asked.select("_host", "_rows", "ending", longer.alias("_longer"), shorter.alias("_shorter"))
    suffix = F.when(F.col("kind") == "exception", F.col("_shorter")).when(F.col("kind") == "wildcard", F.col("_longer")).otherwise(F.col("ending"))
    found = asked.join(rules.select("ending", "kind"), "ending", "left")
    found = found.withColumn("_suffix", F.when(F.col("kind").isNotNull(), suffix))
    order = F.when(F.col("_suffix").isNotNull(), F.struct(F.col("kind") == "exception", F.length("_suffix")))
    best = found.groupBy("_host", "_rows").agg(F.max_by("_suffix", order).alias("suffix"))
    # Without a rule the last label counts, the default rule of public suffix lists.
    best = best.withColumn("suffix", F.coalesce("suffix", U.default_suffix("_host")))
    best = best.select("_host", "_rows", U.domain_of("_host", F.col("suffix")).alias("domain"), "suffix")
    out = attach(hosted, best, ["_host"], weight="_rows")
    fill = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(*df.columns, fill("domain"), fill("suffix"))
