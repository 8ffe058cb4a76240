"""S4: JSON preview of the first rows in a stated order (TakeOrderedAndProject)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.functions.parse import col


def preview(df: DataFrame, order_by, n: int = 10) -> DataFrame:
    """First ``n`` rows by ``order_by`` as (rank, json). Row order is not defined in
    Spark, so the order key is required; the top-n is computed per partition and
    merged, never by sorting everything."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    top = df.orderBy(*[col(c) for c in order]).limit(n)
    json = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return top.select(json.alias("row_json"), *[col(c) for c in order])
