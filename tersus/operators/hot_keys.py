"""Joins whose hot keys are split over many tasks, full outer joins included.

A hash join sends all rows of a key to one task. Here the keys that hold more than their share of either side are
found first, and their rows are dealt over a grid: a left row goes to one line of its key's grid and is repeated for
every column, a right row goes to one column and is repeated for every line, so each pair meets in exactly one cell.
A cell is part of the join key. Keys that are not hot have a grid of one cell, so one join serves all.

1. One pass over both keys counts rows by ``BUCKETS`` hash buckets. Bucket counts add up, whatever the order they are
   merged in, and a key never counts for more than its bucket, so no hot key is missed.
2. A second pass counts single keys, but only in buckets that hold more than a key's share. What is over it is written
   to the scratch folder: at most ``parts`` keys for each side, which is the proven bound of the one broadcast.
3. Both sides look up their grid, then comes the join. In an outer join a repeated row finds no partner in an empty cell
   of its grid although it has some in others: such rows go, as step 2 counted exactly which hot keys both sides hold.

A row's line or column is a hash of its values and of its partition, so a task that runs again deals it alike whatever
the order of its rows, and equal rows of different partitions part ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tersus.functions.parse import col
from tersus.session import scratch_dir

#: Hash buckets of the first pass; that many counts a side reach the driver.
BUCKETS = 1 << 16


def _hashable(t: DataType) -> bool:
    if isinstance(t, StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    if isinstance(t, ArrayType):
        return _hashable(t.elementType)
    return not isinstance(t, (MapType, VariantType))


def common_type(left: DataFrame, lkey: str, right: DataFrame, rkey: str) -> DataType:
    """The type that the keys of both sides are compared and hashed by."""
    return left.select(col(lkey).alias("k")).union(right.select(col(rkey).alias("k"))).schema["k"].dataType


def hot_keys(left: DataFrame, lkey: str, right: DataFrame, rkey: str, parts: int) -> tuple[DataFrame, int, int]:
    """The keys with more than 1 / ``parts`` of the rows of either side, with their exact numbers of rows on both: a
    written table (k, l, r), and the rows of both sides. NULL is a key like any other."""
    spark, kind = left.sparkSession, common_type(left, lkey, right, rkey)
    sides = left.select(col(lkey).cast(kind).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        right.select(col(rkey).cast(kind).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = sides.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).cast("int"))
    counts = [F.sum("l").alias("l"), F.sum("r").alias("r")]
    buckets = sides.groupBy("b").agg(*counts).toArrow().to_pydict()  # at most BUCKETS rows
    rows = sum(buckets["l"]), sum(buckets["r"])
    over = [F.col(c) > F.lit(n / parts) for c, n in zip("lr", rows)]
    heavy = [b for b, l, r in zip(buckets["b"], buckets["l"], buckets["r"]) if l > rows[0] / parts or r > rows[1] / parts]
    path = scratch_dir(spark, "hot-keys")
    found = sides.where(F.col("b").isin(heavy)).groupBy("k").agg(*counts).where(over[0] | over[1])
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path), *rows


def grid(l: Column, r: Column, rows: tuple[int, int], parts: int) -> tuple[Column, Column]:
    """Lines and columns of the grid of a key with ``l`` and ``r`` rows: as many as keep both its rows and its pairs in
    a cell under 1 / ``parts``. A key that is hot on both sides has many more pairs than rows, so ``parts`` cells do."""
    lines = F.greatest(l * F.lit(parts / max(rows[0], 1)), F.lit(1.0))
    columns = F.greatest(r * F.lit(parts / max(rows[1], 1)), F.lit(1.0))
    shrink = F.greatest(F.lit(1.0), F.sqrt(lines * columns / F.lit(float(parts))))
    # one side alone may be hot: it keeps its share, the other is not repeated
    both = (lines > 1) & (columns > 1)
    return (F.ceil(F.when(both, F.greatest(lines / shrink, F.lit(1.0))).otherwise(lines)).cast("int"),
            F.ceil(F.when(both, F.greatest(columns / shrink, F.lit(1.0))).otherwise(columns)).cast("int"))


def join_split(left: DataFrame, right: DataFrame, lkey: str, rkey: str, how: str = "inner", *,
               null_keys_match: bool = True, parts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` where ``lkey`` equals ``rkey``; column names must differ. ``how``: inner, left,
    right or full_outer. Same rows as the plain join.

    ``parts`` (default: the session's shuffle partitions, at most a quarter of ``BUCKETS``): a task is to hold about that
    part of the rows or pairs. Two jobs over the keys alone run at once; both sides are read three times, so one that takes
    long to compute should be written before. With no hot keys nothing is repeated; empty sides are no special case.
    """
    spark = left.sparkSession
    parts = max(2, min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS // 4))
    kind = common_type(left, lkey, right, rkey)
    hot, *rows = hot_keys(left, lkey, right, rkey, parts)
    lines, columns = grid(F.col("l"), F.col("r"), tuple(rows), parts)
    # rows that meet nothing, so they are dealt but never repeated
    none = F.lit(False) if null_keys_match else F.col("k").isNull()
    hot = hot.select(F.col("k").alias("__hk"), lines.alias("__lines"), columns.alias("__columns"),
                     ((F.col("l") > 0) & (F.col("r") > 0) & ~none).alias("__met"), none.alias("__none"))

    def dealt(df: DataFrame, key: str, side: str, own: str, other: str) -> DataFrame:
        values = [col(f.name) for f in df.schema if _hashable(f.dataType)]
        place = F.xxhash64(*values, F.spark_partition_id())
        cells = F.when(F.col("__none"), F.lit(1)).otherwise(F.coalesce(F.col(other), F.lit(1)))
        numbered = df.withColumn("__place", place).join(F.broadcast(hot), col(key).cast(kind).eqNullSafe(F.col("__hk")), "left")
        return numbered.select(
            *[col(c) for c in df.columns], F.coalesce(F.col("__met"), F.lit(False)).alias(f"__met_{side}"),
            F.pmod(F.col("__place"), F.coalesce(F.col(own), F.lit(1))).cast("int").alias(f"__{own[2:]}_{side}"),
            F.explode(F.sequence(F.lit(0), cells - 1)).alias(f"__{other[2:]}_{side}"))

    l2 = dealt(left, lkey, "l", "__lines", "__columns")
    r2 = dealt(right, rkey, "r", "__columns", "__lines")
    l2, r2 = l2.withColumn("__in_l", F.lit(True)), r2.withColumn("__in_r", F.lit(True))
    same = col(lkey).eqNullSafe(col(rkey)) if null_keys_match else col(lkey) == col(rkey)
    cell = (F.col("__lines_l") == F.col("__lines_r")) & (F.col("__columns_l") == F.col("__columns_r"))
    joined = l2.join(r2, same & cell, how)
    if how != "inner":  # an empty cell is no lack of partners
        alone = F.col("__in_l").isNull() | F.col("__in_r").isNull()
        joined = joined.where(~(alone & F.coalesce(F.col("__met_l"), F.col("__met_r"))))
    return joined.select(*[col(c) for c in [*left.columns, *right.columns]])
