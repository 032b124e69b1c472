"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_by_language(
    df: DataFrame,
    path: str,
    languages: Sequence[str] | None = None,
    column: str = "wikidb",
    mode: str = "overwrite",
    max_records: int = 5_000_000,
) -> None:
    """All languages in one pass, one folder each; rows without one go to the default folder, which reads back
    as NULL. ``languages`` writes only the listed ones. Rows stay where they are (no shuffle), so a large
    language is written by many tasks; ``max_records`` bounds the size of a file."""
    if languages is not None:
        df = df.filter(F.col(column).isin(list(languages)))
    df.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(column).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def bounded_collect(df: DataFrame, n: int) -> list[Row]:
    """Never more than ``n`` rows on the driver."""
    return df.limit(n).collect()
