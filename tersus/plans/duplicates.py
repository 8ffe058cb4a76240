"""P3/Q6 by sketches: an estimate of the duplicates of a table that grows, from one small sketch a batch (H5).

The exact count (``profile.duplicate_count``) shuffles every distinct row. A HyperLogLog sketch of the rows takes one scan
without a shuffle of rows, and sketches of parts merge into that of the whole, so a stream is not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.errors import require_column
from tersus.functions.parse import col
from tersus.streaming.ingest import run_stream

#: Sketch registers, as a power of two: 16 KB a sketch.
LOG_REGISTERS = 14
SCHEMA = "rows long, sketch binary"


def error_bound(log_registers: int = LOG_REGISTERS) -> float:
    """What the distinct rows may be off by, as a share of them: three standard errors of a merged sketch (so one
    estimate in some hundreds is beyond)."""
    return 3 * 1.04 / 2 ** (log_registers / 2)


def row_sketch(df: DataFrame, subset=None, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """One row (rows, sketch) for the rows of ``df``, compared by ``subset`` (all columns if not given). NULL equals
    NULL. Rows are known by 64 bits of hash. An empty table has zero rows and an empty sketch."""
    columns = list(subset) if subset else df.columns
    for c in columns:
        require_column(df, c)
    # a hash passes over NULLs, so which columns are NULL is hashed, too
    known = F.xxhash64(*[x for c in columns for x in (col(c).isNull(), col(c))])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(known, F.lit(log_registers)).alias("sketch"))


def duplicate_estimate(sketches: DataFrame, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """From any number of (rows, sketch): (rows, distinct_estimate, duplicate_estimate, error). The duplicates are the rows
    less the distinct ones, never below zero; ``error`` is what either may be off by, in rows."""
    whole = sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    distinct = F.least(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)), F.col("rows"))
    return whole.select("rows", distinct.alias("distinct_estimate"), (F.col("rows") - distinct).alias("duplicate_estimate"),
                        F.ceil(distinct * F.lit(error_bound(log_registers))).alias("error"))


def sketch_to_sink(stream: DataFrame, sink: str, checkpoint: str, subset=None, log_registers: int = LOG_REGISTERS,
                   trigger: dict | None = None):
    """A sketch of each micro-batch, one row a batch; one that is tried again replaces its own."""
    return run_stream(stream.writeStream.foreachBatch(
        lambda batch, batch_id: row_sketch(batch, subset, log_registers).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")),
        checkpoint, trigger)


def read_sketches(spark, sink: str) -> DataFrame:
    """The sketches that ``sketch_to_sink`` has written so far."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(sink)
