"""Whole documents in files: one valid file per building, and readers from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(lines: DataFrame) -> DataFrame:
    """The lines of a building in one task, and the buildings over all tasks:
    files are many and small, so tasks are not merged by their bytes."""
    return lines.repartition(_tasks(lines.sparkSession), "building_id")


def write(lines: DataFrame, path: str, order: list[str]) -> None:
    """lines(building_id, order..., line) to one text file per building, in
    `<path>/building_id=<id>`. The lines of a building meet in one task, in order,
    and stream into its file; no document stands in a cell. A file appears when
    its whole job commits."""
    write_spread(spread(lines), path, order)


def write_spread(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """The same for lines that come from ``spread``; ``text`` is what is written of a line."""
    (
        lines.sortWithinPartitions("building_id", *order)
        .select("building_id", F.col(text).alias("value"))
        .write.option("maxRecordsPerFile", 0)
        .partitionBy("building_id")
        .text(path)
    )


def read(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(file_id, text) of every file below a path; `file_id` is its full name.
    `pattern` picks files by name, such as `*.json`. A task lists many folders,
    where Spark would else start one for each."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(_tasks(spark)))
    try:
        texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    finally:
        spark.conf.set(LISTERS, before)
    return texts.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("text"))
