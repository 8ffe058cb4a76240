"""Outlier filters O1-O3: ``filter_outliers`` and ``filter_range``.

NULL and unparseable values are always kept; the column keeps its type (only
the mask is numeric). Bounds are fitted into literals, so the filter is a
codegen'd predicate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import to_double
from tersus.functions.stats import FitBatch

METHODS = ("iqr", "zscore")


@dataclass(frozen=True)
class FittedOutlierFilter:
    column: str
    method: str
    threshold: float
    a: float | None   # iqr: lower bound, zscore: mean
    b: float | None   # iqr: upper bound, zscore: sample std

    def keep_expr(self, df: DataFrame):
        num = to_double(self.column, df.schema[self.column].dataType)
        if self.method == "iqr":
            if self.a is None:
                return F.lit(True)
            return F.coalesce(num.between(F.lit(self.a), F.lit(self.b)), F.lit(True))
        m = F.lit(self.a).cast("double")
        s = F.lit(self.b).cast("double")
        z = F.abs(F.try_divide(num - m, s))
        return num.isNull() | F.coalesce(z <= F.lit(self.threshold), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.keep_expr(df))

    transform = apply


class OutlierFitter:
    def __init__(self, df: DataFrame, column: str, method: str = "iqr", threshold=3.0, *,
                 approx: bool = False, table: str = "<dataframe>"):
        require_column(df, column, table)
        self.column = column
        self.method = (method or "iqr").lower()
        if self.method not in METHODS:
            raise CleaningError(f"no outlier method {self.method!r}; choose one of {METHODS}")
        self.threshold = 1.5 if threshold is None else float(threshold)
        self.approx = approx
        self.dt = df.schema[column].dataType
        self.key = f"out:{id(self)}:{column}"

    def request(self, batch: FitBatch) -> None:
        num = to_double(self.column, self.dt)
        if self.method == "iqr":
            batch.quantile(self.key, num, [0.25, 0.75], approx=self.approx)
        else:
            batch.agg(self.key + ":m", F.avg(num))
            batch.agg(self.key + ":s", F.stddev_samp(num))

    def finish(self, res: dict) -> FittedOutlierFilter:
        t = self.threshold
        if self.method == "iqr":
            q1, q3 = res[self.key]
            if q1 is None:
                return FittedOutlierFilter(self.column, "iqr", t, None, None)
            iqr = q3 - q1
            return FittedOutlierFilter(self.column, "iqr", t, q1 - t * iqr, q3 + t * iqr)
        s = res[self.key + ":s"]
        if s is not None and s != s:
            s = None
        return FittedOutlierFilter(self.column, "zscore", t, res[self.key + ":m"], s)


def filter_outliers(df: DataFrame, column: str, method: str = "iqr", threshold=3.0, *,
                    approx: bool = False) -> DataFrame:
    """O1 IQR: keep Q1 - t*IQR <= x <= Q3 + t*IQR (exact linear quantiles; ``approx``
    uses percentile_approx). O2 z-score: keep |x - mean| / std_samp <= t; a zero or
    undefined std drops every non-null row, as the reference does."""
    f = OutlierFitter(df, column, method, threshold, approx=approx)
    batch = FitBatch(df)
    f.request(batch)
    return f.finish(batch.run()).apply(df)


def filter_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """O3: fixed-range filter, NULLs kept; no fit needed."""
    require_column(df, column)
    num = to_double(column, df.schema[column].dataType)
    return df.where(num.isNull() | num.between(F.lit(float(lo)), F.lit(float(hi))))
