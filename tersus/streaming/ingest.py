"""ST1: ingest dirty micro-batches with Structured Streaming.

Files are read with a declared raw schema (dirty columns are strings, H4), so
a batch holding a text amount cannot change a column's type.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Keyed state in RocksDB: on the executors' disks, checkpointed by what each batch changed.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that start inside keep their state as ``STATE_CONF`` says; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = 1) -> DataFrame:
    """Streaming read of a folder of files with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def run_stream(stream_writer, checkpoint: str, trigger: dict | None = None):
    """Start a ``DataStreamWriter``.

    The default trigger ``{"availableNow": True}`` consumes everything available, however long that takes,
    and returns when the query has ended. Any other trigger, e.g. ``{"processingTime": "1 minute"}``, runs
    on: the running query is returned at once, for the caller to watch and stop.
    """
    trigger = trigger or {"availableNow": True}
    q = stream_writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if trigger.get("availableNow") or trigger.get("once"):
        q.awaitTermination()  # raises what made the query fail
    return q
