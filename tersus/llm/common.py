"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersus.session import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of text that Spark hands a Python worker at once (one longer text still goes as a whole).
BATCH_BYTES = 8 << 20


#: The folder that holds the package, for workers that run on the driver's machine.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare_workers(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (the JVM and the worker each hold one per running task, and the
    default of 64 MB leaves small executors little room), and let workers import this package from where the
    driver did. On a cluster the package is installed, or sent with ``--py-files``, as usual."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` (long) and ``text`` (null becomes empty); other columns are left behind."""
    prepare_workers(df.sparkSession)
    return df.select(col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from files that outlive any executor."""
    path = scratch_dir(df.sparkSession, "llm", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mounted(path: str) -> str:
    """The path by which a task opens files of the shared folder: ``file:`` URLs and plain paths.

    Files that tasks map into memory must lie on a mounted file system (NFS,
    Lustre, a FUSE mount ...); other schemes are refused rather than copied.
    """
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted shared folder for this operator, not {url.scheme}:")
    return url.path


def write_atomically(path: str, data: bytes) -> None:
    """Write a shared file so that retried and speculative tasks leave one whole copy."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex[:12]}.tmp"
    with open(temporary, "wb") as f:
        f.write(data)
    os.replace(temporary, path)


def keep_freed_memory(large: int = 64 << 20, kept: int = 96 << 20) -> None:
    """In a worker: let the C library reuse freed arrays of up to ``large`` bytes, keeping at most about ``kept``
    free, instead of returning each to the system and having it zeroed again for the next. glibc only."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, large)  # M_MMAP_THRESHOLD
        mallopt(-1, kept)  # M_TRIM_THRESHOLD


def return_freed_memory() -> None:
    """In a worker: give freed memory back to the system, Arrow's and (glibc only) the C library's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
