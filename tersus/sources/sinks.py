"""Sinks: write cleaned tables with Spark's built-in writers (S3's "caller may
writeTo / saveAsTable")."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None, table: str | None = None, **options) -> None:
    """Write ``df`` to ``path`` in ``fmt`` or, with ``table``, save it as a catalog table."""
    w = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if table:
        w.saveAsTable(table)
    else:
        w.save(path)


def write_tables(tables, root: str, fmt: str = "parquet", mode: str = "overwrite") -> dict:
    """Write every table of a set under ``root/<name>``; returns name -> path."""
    paths = {}
    for name in tables:
        paths[name] = os.path.join(root, name)
        write_table(tables[name], paths[name], fmt, mode)
    return paths
