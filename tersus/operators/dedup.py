"""Deduplication D1-D3: ``remove_duplicates``.

Full-row dedup is a hash aggregate (partial aggregation collapses hot rows
map-side). Keep-first/last per key subset is ``row_number() = 1``; Catalyst
plans a partial ``WindowGroupLimit`` before the shuffle, so a hot key sends at
most one row per map partition across the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import col


def remove_duplicates(df: DataFrame, subset=None, keep: str = "first", order_by=None) -> DataFrame:
    """D1 without ``subset``: one of each set of identical rows. With it, one row per key: ``keep`` 'first' or
    'last' in ``order_by`` order (required, as Spark's rows have no order of their own), or 'any'."""
    if keep not in ("first", "last", "any"):
        raise CleaningError(f"keep={keep!r} is not supported; use 'first', 'last' or 'any'")
    if not subset:
        return df.dropDuplicates()  # D1: identical rows, keep is irrelevant
    subset = list(subset)
    for c in subset:
        require_column(df, c)
    if keep == "any":
        return df.dropDuplicates(subset)
    if not order_by:
        raise CleaningError(f"keep={keep!r} needs 'order_by'; use keep='any' if any copy will do")
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    for c in order_cols:
        require_column(df, c)
    # remaining columns break ties so the result is deterministic even for a non-unique order key
    rest = [c for c in df.columns if c not in subset and c not in order_cols]
    cols = order_cols + rest
    spec = [col(c).asc_nulls_first() for c in cols] if keep == "first" else \
        [col(c).desc_nulls_last() for c in cols]
    w = Window.partitionBy(*[col(c) for c in subset]).orderBy(*spec)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
