"""Key joins J1-J5: ``merge_tables``.

Single-column equi-join on a same-named key. By default NULL keys match each
other (``<=>``), like a pandas merge; Spark still plans a hash/sort-merge join
on null-safe keys. ``null_keys_match=False`` gives the plain SQL join, which
lets Catalyst push ``IsNotNull`` into both scans.

No join strategy is forced: the broadcast decision is Spark's, made against
``spark.sql.autoBroadcastJoinThreshold`` from plan statistics and again by AQE
from the measured shuffle size; a skewed key is split by AQE skew-join
handling (inner/left/right). A full outer join is Spark's own, one shuffle a
side, and AQE does not split its keys; ``split_hot`` does (``hot_keys``), for any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.errors import CleaningError
from tersus.functions.parse import col, is_numeric, is_string
from tersus.operators.hot_keys import join_split

HOWS = ("inner", "left", "right", "outer")


def merge_tables(left: DataFrame, right: DataFrame, on: str, how: str = "inner", *,
                 null_keys_match: bool = True, suffixes=("_x", "_y"), split_hot: bool = False,
                 left_name: str = "left", right_name: str = "right") -> DataFrame:
    """``null_keys_match`` (the default, as in pandas) joins every row without a key to every other one: with
    many of them on both sides that is their product, so drop or fill such keys first, or pass False.

    ``split_hot`` deals the rows of hot keys over many tasks, full outer joins included, which takes two jobs over the keys
    first. The rows are the same. Streams are joined plainly: their keys cannot be counted first."""
    how = how or "inner"
    if how not in HOWS:
        raise CleaningError(f"join type {how!r} is not one of {HOWS}")
    if on not in left.columns:
        raise CleaningError(f"the left table {left_name!r} has no key column {on!r}, only {left.columns}")
    if on not in right.columns:
        raise CleaningError(f"the right table {right_name!r} has no key column {on!r}, only {right.columns}")
    lt, rt = left.schema[on].dataType, right.schema[on].dataType
    if is_string(lt) != is_string(rt) or is_numeric(lt) != is_numeric(rt):
        # a text key against a numeric key would be cast row by row and fail at run time
        raise CleaningError(f"Key '{on}' has type {lt.simpleString()} in '{left_name}' but "
                            f"{rt.simpleString()} in '{right_name}'; cast one side first")
    overlap = [c for c in left.columns if c != on and c in right.columns]
    lnames = {c: (c + suffixes[0] if c in overlap else c) for c in left.columns}
    rnames = {c: (c + suffixes[1] if c in overlap else c) for c in right.columns if c != on}
    lk, rk = "__lk", "__rk"
    l2 = left.select(*[col(c).alias(lk if c == on else lnames[c]) for c in left.columns])
    r2 = right.select(*[col(c).alias(rk if c == on else rnames[c]) for c in right.columns])
    kind = "full_outer" if how == "outer" else how
    if split_hot and not (left.isStreaming or right.isStreaming):
        joined = join_split(l2, r2, lk, rk, kind, null_keys_match=null_keys_match)
    else:
        joined = l2.join(r2, l2[lk].eqNullSafe(r2[rk]) if null_keys_match else (l2[lk] == r2[rk]), kind)
    if how == "right":
        key = F.col(rk)
    elif how == "outer":
        key = F.coalesce(F.col(lk), F.col(rk))
    else:
        key = F.col(lk)
    cols = [key.alias(on) if c == on else col(lnames[c]) for c in left.columns]
    return joined.select(*cols, *[col(rnames[c]) for c in right.columns if c != on])
