"""Derived columns X1-X7: ``add_derived_column``. NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import DATE_FORMATS, col, is_integral, to_double, to_timestamp

TRANSFORMS = ("year_from_date", "month_from_date", "log1p", "abs", "len", "upper", "lower")


def derive_expr(df: DataFrame, source: str, transform: str, formats=DATE_FORMATS):
    dt = df.schema[source].dataType
    t = (transform or "").lower()
    c = col(source)
    if t == "year_from_date":
        return F.year(to_timestamp(source, dt, formats))
    if t == "month_from_date":
        return F.month(to_timestamp(source, dt, formats))
    if t == "log1p":
        return F.log1p(to_double(source, dt))
    if t == "abs":
        if is_integral(dt):
            # exact, not through a double; the least long has no counterpart and becomes NULL
            return F.when(c > F.lit(-2 ** 63), F.abs(c)) if isinstance(dt, T.LongType) else F.abs(c)
        return F.abs(to_double(source, dt))
    if t == "len":
        return F.length(c.cast("string"))
    if t == "upper":
        return F.upper(c.cast("string"))
    if t == "lower":
        return F.lower(c.cast("string"))
    raise CleaningError(f"no transform {t!r}; choose one of {TRANSFORMS}")


def add_derived_column(df: DataFrame, column_name: str, source_column: str, transform: str,
                       formats=DATE_FORMATS) -> DataFrame:
    if not column_name:
        raise CleaningError("a derived column needs a name")
    if not source_column:
        raise CleaningError("a derived column needs a source column")
    require_column(df, source_column)
    return df.withColumn(column_name, derive_expr(df, source_column, transform, formats))
