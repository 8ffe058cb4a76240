"""Stages a table as the files of a replayable stream source, for the suite and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersus.session import scratch_dir

#: Small row groups: the tasks of a micro-batch share its one file.
WRITE = {"parquet.block.size": str(2 << 20)}


def stage_batches(df: DataFrame, spark: SparkSession, batch: str, files: int = 5, path: str | None = None) -> str:
    """``df`` as about ``files`` files, in one write; ``batch`` (a column) stays together in a file."""
    path = path or scratch_dir(spark, "stage")
    df.repartition(files, batch).write.options(**WRITE).parquet(path)
    return path


def stage_in_order(df: DataFrame, spark: SparkSession, part, parts: int, path: str | None = None) -> str:
    """File after file, one for each value 0 .. ``parts`` - 1 of ``part``: a stream that takes one file a
    trigger gets exactly these batches in this order."""
    path = path or scratch_dir(spark, "stage")
    for i in range(parts):
        df.where(part == F.lit(i)).repartition(1).write.mode("append").options(**WRITE).parquet(path)
    return path
