"""Order-based fills N6/N7 without a single-partition window (H1).

A window with no ``partitionBy`` moves every row into one task. Instead:

1. the group keys, the order key and the column alone are range-partitioned by the whole order key into buckets and
   written to the scratch folder with their bucket number, so every later step sees the same buckets;
2. one small aggregate per (group, bucket) keeps the last (first) non-null value, and a window over that summary
   carries values across buckets;
3. a window inside each bucket and the carried value give the value of each key whose column is NULL;
4. of the table itself only the rows to fill are joined with those, by their keys; the others are neither
   shuffled nor written.

The result does not depend on the number of buckets. NULL order keys come first, in the buckets as in the windows. The
order key should be unique within a group: rows that share it get one value, the largest that any of them would
get. The table is read three times, so one that takes long to compute should be written before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersus.errors import require_column
from tersus.functions.parse import col
from tersus.session import scratch_dir


def ordered_fill(df: DataFrame, column: str, order_by, partition_by, direction: str = "forward",
                 buckets: int | None = None) -> DataFrame:
    """``buckets``: the session's shuffle partitions if not given, small ones merged by AQE; one bucket's
    keys are sorted by one task."""
    spark = df.sparkSession
    order_cols = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = list(partition_by)
    for c in order_cols + keys + [column]:
        require_column(df, c)
    forward = direction == "forward"
    group, places = [f"g{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order_cols))]
    order = [F.col(c).asc_nulls_first() for c in places]
    narrow = df.select(*[col(c).alias(n) for c, n in zip(keys + order_cols, group + places)], col(column).alias("v"))
    path = scratch_dir(spark, "ordered-fill")
    ranged = narrow.repartitionByRange(buckets, *order) if buckets else narrow.repartitionByRange(*order)
    bucketed = ranged.withColumn("__bucket", F.spark_partition_id())
    bucketed.write.parquet(path)
    data = spark.read.schema(bucketed.schema).parquet(path)

    in_bucket = Window.partitionBy(*group, "__bucket").orderBy(*order)
    if forward:
        local = F.last("v", ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    else:
        local = F.first("v", ignorenulls=True).over(in_bucket.rowsBetween(0, Window.unboundedFollowing))

    # one row per (group, bucket), also for buckets holding only nulls: the edge value nearest to
    # the next (previous) bucket. Struct order puts NULL fields first, as the windows do.
    place = F.when(F.col("v").isNotNull(), F.struct(F.lit(0), *places))
    pick = F.max_by if forward else F.min_by
    summary = data.groupBy(*group, "__bucket").agg(pick("v", place).alias("edge"))
    across = Window.partitionBy(*group).orderBy("__bucket")
    if forward:
        carried = F.last("edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    else:
        carried = F.first("edge", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    summary = summary.select(*[F.col(c).alias(f"s{c}") for c in [*group, "__bucket"]], carried.alias("carry"))
    # null-safe: a NULL group key is one group for the window, so it must match here too
    same = [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in [*group, "__bucket"]]
    gaps = data.withColumn("near", local).where("v IS NULL").join(summary, same, "left")
    found = (gaps.select(*group, *places, F.coalesce("near", "carry").alias("v")).where("v IS NOT NULL")
             .groupBy(*group, *places).agg(F.max("v").alias("v")))
    found = found.select(*[F.col(c).alias(f"__{c}") for c in [*group, *places, "v"]])
    match = [col(c).eqNullSafe(F.col(f"__{n}")) for c, n in zip(keys + order_cols, group + places)]
    filled = df.where(col(column).isNull()).join(found, match, "left").select(
        *[F.col("__v").alias(c) if c == column else col(c) for c in df.columns])
    return df.where(col(column).isNotNull()).unionByName(filled)
