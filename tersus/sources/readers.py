"""Readers: Spark's built-in file sources with a declared schema.

Dirty inputs are read with an all-string schema for the dirty columns (H4):
Spark has no mixed-type column, and a declared schema avoids inference scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tersus.sources.catalog import TableSet

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Raw schema of a dirty transaction stream (scenario 4 shape): everything dirty is a string.
RAW_STREAM_SCHEMA = ("txn_id STRING, customer_id BIGINT, amount STRING, category STRING, "
                     "region STRING, event_ts STRING")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class LazyTableSet(TableSet):
    """A TableSet whose tables are opened on first use (no listing of unused tables)."""

    def __init__(self, loaders: dict):
        super().__init__({})
        self._loaders = loaders

    def __getitem__(self, name):
        if name not in self._t and name in self._loaders:
            self._t[name] = self._loaders[name]()
        return super().__getitem__(name)

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self):
        return len(self._loaders)

    def __contains__(self, name):
        return name in self._loaders

    def bind(self, name, df):
        return TableSet({**{n: self[n] for n in self._loaders}, name: df})


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> TableSet:
    """The tables of a folder, each opened (and found missing) only on first use: nothing is listed here, so
    any path that Spark can read will do."""
    return LazyTableSet({n: (lambda n=n: read_table(spark, sf_dir, n)) for n in names})


def read_raw(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read any built-in format (parquet/csv/json/orc) with a declared schema."""
    reader = spark.read.schema(schema).options(**options)
    return reader.format(fmt).load(path)
