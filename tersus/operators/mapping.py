"""V7: values replaced by a mapping table, for synonyms that no rule of V1-V6 makes equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersus.errors import CleaningError, require_column
from tersus.functions.parse import col, is_string
from tersus.functions.text import strip_ws
from tersus.operators.hot_keys import join_split

#: A mapping of at most so many bytes, as counted, is broadcast.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast table takes beside its text.
ROW_BYTES = 64


def _folded(c, fold: bool):
    return F.lower(strip_ws(c)) if fold else c


def _checked(mapping: DataFrame, value: str, canonical: str, fold: bool) -> tuple[DataFrame, int]:
    """The mapping as (__from, __to), a row for each value, and its size in bytes. Refuses NULLs and values that lead to
    different texts, after one job over the mapping."""
    for c in (value, canonical):
        require_column(mapping, c, "mapping")
    rows = mapping.select(_folded(col(value).cast("string"), fold).alias("__from"), col(canonical).cast("string").alias("__to"))
    one = rows.groupBy("__from").agg(F.min("__to").alias("__to"), F.max("__to").alias("last"),
                                     F.count_if(F.col("__to").isNull()).alias("nulls"))
    bad = F.col("__from").isNull() | (F.col("nulls") > 0)
    twice = F.col("__to") != F.col("last")
    size = F.octet_length("__from") + F.octet_length("__to") + ROW_BYTES
    found = one.agg(F.count_if(bad).alias("bad"), F.min(F.when(twice, F.col("__from"))).alias("twice"), F.sum(size).alias("size")).first()
    if found["bad"]:
        raise CleaningError(f"the mapping holds {found['bad']} rows with NULL")
    if found["twice"] is not None:
        raise CleaningError(f"the mapping has more than one result for {found['twice']!r}")
    return one.select("__from", "__to"), found["size"] or 0


def _looked_up(df: DataFrame, column: str, mapping, value: str, canonical: str, fold: bool, broadcast_bytes: int) -> DataFrame:
    """``df`` with ``__to``: what its value maps to, NULL if to nothing."""
    require_column(df, column)
    if not is_string(df.schema[column].dataType):
        raise CleaningError(f"column {column!r} is no text, so no mapping of texts can be applied")
    if isinstance(mapping, dict):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), f"`{value}` string, `{canonical}` string")
    pairs, size = _checked(mapping, value, canonical, fold)
    keyed = df.withColumn("__key", _folded(col(column), fold))
    if size <= broadcast_bytes or df.isStreaming:
        joined = keyed.join(F.broadcast(pairs) if size <= broadcast_bytes else pairs, F.col("__key") == F.col("__from"), "left")
    else:  # a frequent value is dealt over many tasks
        joined = join_split(keyed, pairs, "__key", "__from", "left", null_keys_match=False)
    return joined.drop("__key", "__from")


def map_values(df: DataFrame, column: str, mapping, value: str = "value", canonical: str = "canonical", *,
               fold: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Replace each text of ``column`` by what ``mapping`` (a table of ``value`` and ``canonical`` columns, or a dict)
    makes of it. Values without an entry stay as they are, and NULL stays NULL; see ``unmapped_values``.

    ``fold``: compare without case and surrounding white space. Entries that are then alike must agree: a value with two
    results is refused, and so is a NULL in the mapping. A mapping is broadcast if its counted size is at most
    ``broadcast_bytes``, else joined, with frequent values split. An empty mapping changes nothing.
    """
    found = _looked_up(df, column, mapping, value, canonical, fold, broadcast_bytes)
    return found.select(*[F.coalesce(F.col("__to"), col(c)).alias(c) if c == column else col(c) for c in df.columns])


def unmapped_values(df: DataFrame, column: str, mapping, value: str = "value", canonical: str = "canonical", *,
                    fold: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(value, n): the texts of ``column`` that ``mapping`` has no entry for, and how often each occurs."""
    found = _looked_up(df.select(col(column)), column, mapping, value, canonical, fold, broadcast_bytes)
    return (found.where(F.col("__to").isNull() & col(column).isNotNull())
            .groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))
