"""Registration of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import shared_folder
from linkloom.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t("pages")`` reads a driver table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        # Long texts in one small file: see spread().
        return spread(df) if name == "documents" else df

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self, name: str) -> str:
        """A new folder for a round trip, shared by all executors."""
        return shared_folder(self.spark, name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, as in the SQL twins."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def ids(c: str) -> Column:
    return F.col(c).cast("string")
