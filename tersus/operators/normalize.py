"""Value normalisation V1-V6: ``normalize_values``. NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import col
from tersus.functions.text import python_pattern_to_java, python_replacement_to_java, strip_ws, title_case

METHODS = ("upper", "lower", "strip", "title", "regex", "replace")


def normalize_expr(c, method: str, pattern=None, replacement=None):
    m = (method or "upper").lower()
    s = c.cast("string")
    if m == "upper":
        return F.upper(strip_ws(s))
    if m == "lower":
        return F.lower(strip_ws(s))
    if m == "strip":
        return strip_ws(s)
    if m == "title":
        return title_case(strip_ws(s))
    if m in ("regex", "replace"):
        if not pattern:
            raise CleaningError(f"{m!r} needs a pattern")
        repl = replacement or ""
        if m == "regex":
            return F.regexp_replace(s, F.lit(python_pattern_to_java(pattern)),
                                    F.lit(python_replacement_to_java(repl)))
        return F.replace(s, F.lit(pattern), F.lit(repl))
    raise CleaningError(f"no normalisation {m!r}; choose one of {METHODS}")


def normalize_values(df: DataFrame, column: str, method: str = "upper", pattern: str | None = None,
                     replacement: str | None = None) -> DataFrame:
    require_column(df, column)
    return df.withColumn(column, normalize_expr(col(column), method, pattern, replacement))
