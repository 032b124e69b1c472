"""Process a growing folder of files in bounded batches that can be stopped and resumed."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BROKEN = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("error", T.StringType())])


def process_in_batches(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int = 400,
    glob: str = "*.parquet",
) -> int:
    """Run ``transform`` over all files not processed yet; returns the batches run.

    ``source`` is a folder, whose own folders count too, or a single file; ``glob`` holds for the files' names.
    A stream of file names deals the files to batches, and its checkpoint remembers the finished ones: a
    restart goes on where the last run stopped. Each batch writes a folder of its own under ``out``, named
    by its number, and writes it anew when it is repeated, so nothing is lost or doubled. A batch that
    fails is halved until the files that fail alone are found: those are set aside in the batch's table of
    broken files (``broken_files``), all others are written. ``transform`` must treat every file by itself
    (link extraction). Read the result with ``read_processed``.
    """
    # Only the listing is used: the column with the files' content is never read.
    listing = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(listing).option("maxFilesPerTrigger", files_per_batch)
    names = files.option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(source).select("path")
    finished: list[int] = []

    def run(batch: DataFrame, number: int) -> None:
        # At most files_per_batch names.
        paths = sorted(r["path"] for r in batch.collect())
        if not paths:
            return
        folder = f"{out}/batch-{number:06d}"
        broken: list[tuple[str, str]] = []
        _write(spark, paths, schema, transform, f"{folder}/rows", broken)
        spark.createDataFrame(broken, BROKEN).coalesce(1).write.mode("overwrite").parquet(f"{folder}/broken")
        finished.append(number)

    query = names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(finished)


def _write(
    spark: SparkSession, paths: list[str], schema: T.StructType, transform: Callable[[DataFrame], DataFrame], folder: str, broken: list[tuple[str, str]]
) -> None:
    """Write the files' rows to ``folder``; halves of a failed list go to folders inside its own."""
    try:
        transform(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{folder}/all")
    except (PySparkException, Py4JJavaError) as error:
        if len(paths) == 1:
            # Leaves an empty table in place of what a failed write may have begun.
            transform(spark.createDataFrame([], schema)).write.mode("overwrite").parquet(f"{folder}/all")
            broken.append((paths[0], str(error)[:2000]))
            return
        half = len(paths) // 2
        for name, part in (("first", paths[:half]), ("second", paths[half:])):
            _write(spark, part, schema, transform, f"{folder}/{name}", broken)
        transform(spark.createDataFrame([], schema)).write.mode("overwrite").parquet(f"{folder}/all")


def read_processed(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All rows that ``process_in_batches`` has written under ``out``."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/batch-*/rows")


def broken_files(spark: SparkSession, out: str) -> DataFrame:
    """``file_path, error`` of the files that could not be processed."""
    return spark.read.schema(BROKEN).parquet(f"{out}/batch-*/broken")
