"""S5: append a batch of rows to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.functions.parse import col


def force_schema(df: DataFrame, schema) -> DataFrame:
    """Project ``df`` onto ``schema`` (a StructType): missing columns become NULL,
    every column is cast to the declared type."""
    return df.select(*[c.alias(f.name) for f, c in _forced(df, schema)])


def _forced(df: DataFrame, schema):
    for f in schema.fields:
        yield f, (col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType)


def append(table: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows and all columns of both. The batch's shared columns are forced onto the table's types (union raw
    with raw: Spark widens string + double to double, which would fail on the next marker string); a column that
    only one side has is NULL in the other's rows."""
    new = [c for c in batch.columns if c not in table.columns]
    forced = [c.alias(f.name) for f, c in _forced(batch, table.schema)]
    return table.unionByName(batch.select(*forced, *[col(c) for c in new]), allowMissingColumns=True)
