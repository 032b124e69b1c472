"""Scans. Every reader takes an explicit schema, so no file is read just to guess types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.urls import reverse_host
from linkloom.schemas import PAGEVIEWS


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Parquet scan of one or many paths. ``skip_corrupt`` leaves unreadable files out; compare
    ``manifest`` with ``list_inputs`` to see which."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


read_pages = read_table


def with_page_key(pages: DataFrame, name: str = "page_key") -> DataFrame:
    """A key for the rows of a file scan: the digest of the file's path and the row's number in the file.

    Pages have no key of their own, and urls repeat. The key is the same in every run over the same
    files, and no two rows share it. It is taken from the scan itself, so call this on what
    ``read_pages`` gives, before any other step.
    """
    at = F.concat_ws(":", F.md5(F.col("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    return pages.select("*", at.alias(name))


def list_inputs(
    spark: SparkSession, path: str, glob: str = "*.parquet", exclude: Sequence[str] = ()
) -> DataFrame:
    """``file_path, n_bytes`` of the matching files, listed by Spark without opening them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    out = files.select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))
    for bad in exclude:
        out = out.filter(~F.contains("file_path", F.lit(bad)))
    return out


def read_listed(spark: SparkSession, path: str, glob: str, schema: T.StructType, exclude: Sequence[str] = ()) -> DataFrame:
    """Scan a folder by glob, without the excluded files (pruned by file path, not by row)."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).parquet(path)
    for bad in exclude:
        df = df.filter(~F.contains("_metadata.file_path", F.lit(bad)))
    return df


def manifest(df: DataFrame) -> DataFrame:
    """Input files of a scan with their row counts."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("n_rows"))


def merge_parts(spark: SparkSession, glob: str, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(glob)


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "wikidb") -> DataFrame:
    """Union by name, each frame marked with its tag."""
    tagged = [df.withColumn(tag, F.lit(name).cast("string")) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def read_tagged(
    spark: SparkSession, paths: str | Sequence[str], pattern: str, tag: str = "wikidb", schema: T.StructType | None = None
) -> DataFrame:
    """The same from one scan: the tag is a piece of the file's path."""
    df = read_table(spark, paths, schema)
    return df.withColumn(tag, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ending, kind) of a public suffix list in its text form; see ``operators.relational.suffix_rules``."""
    from linkloom.operators.relational import suffix_rules

    return suffix_rules(spark.read.schema("rule string").text(path))


def read_domain_ranks(spark: SparkSession, path: str, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """Tab-separated web-graph ranks with a header, hosts written backwards in ``#host_rev``.

    A gzip file is one task; the rows are spread before anything else touches them.
    """
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    spread = raw.repartition(partitions) if partitions else raw.repartition("#host_rev")
    return spread.withColumn("domain", reverse_host(F.col("`#host_rev`")))


def read_pageviews(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(PAGEVIEWS).option("sep", " ").csv(paths if isinstance(paths, str) else list(paths))


def read_named_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False, multiline: bool = False
) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", header).option("multiLine", multiline).option("escape", '"').csv(path)
    )


def sql_view(df: DataFrame, name: str, sql: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a scan that has fewer splits than cores (one small file).

    On a cluster, where scans have far more splits than cores, the frame comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
