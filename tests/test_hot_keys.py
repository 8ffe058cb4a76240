import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tersus.operators import merge_tables
from tersus.operators.hot_keys import BUCKETS, hot_keys, join_split


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def frames(spark, seed, kinds=("long", "long")):
    """Keys with and without hot ones on either side, both and neither, NULL keys and equal rows among them."""
    rng = random.Random(seed)

    def side(hot):
        keys = [rng.choice(hot) if rng.random() < 0.6 else rng.choice([None, *range(40)]) for _ in range(rng.choice([0, 3, 150]))]
        return [(k, rng.randrange(3)) for k in keys]
    return (spark.createDataFrame(side([1, 2, None]), f"lk {kinds[0]}, a int").repartition(3),
            spark.createDataFrame(side([1, 99]), f"rk {kinds[1]}, b int").repartition(2))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full_outer"])
@pytest.mark.parametrize("seed", range(3))
def test_same_rows_as_the_plain_join(spark, how, seed):
    left, right = frames(spark, seed)
    for safe in (True, False):
        same = F.col("lk").eqNullSafe(F.col("rk")) if safe else F.col("lk") == F.col("rk")
        got = join_split(left, right, "lk", "rk", how, null_keys_match=safe, parts=8)
        assert bag(got) == bag(left.join(right, same, how))


@pytest.mark.parametrize("rows", [([], []), ([(1, 1)] * 5, []), ([], [(None, 2)] * 5), ([(None, 1)] * 30, [(None, 2)] * 20)])
def test_empty_sides_and_one_key_alone(spark, rows):
    left, right = spark.createDataFrame(rows[0], "lk int, a int"), spark.createDataFrame(rows[1], "rk int, b int")
    for safe in (True, False):
        same = F.col("lk").eqNullSafe(F.col("rk")) if safe else F.col("lk") == F.col("rk")
        got = join_split(left, right, "lk", "rk", "full_outer", null_keys_match=safe, parts=4)
        assert bag(got) == bag(left.join(right, same, "full_outer"))


def test_keys_of_different_types_and_columns_that_cannot_be_hashed(spark):
    left, right = frames(spark, 2, ("int", "double"))
    left = left.withColumn("m", F.create_map(F.lit("x"), "a")).withColumn("q.d", F.array("a"))
    got = join_split(left, right, "lk", "rk", "full_outer", parts=4)
    assert got.columns == ["lk", "a", "m", "q.d", "rk", "b"]
    plain = left.join(right, F.col("lk").eqNullSafe(F.col("rk")), "full_outer")
    text = lambda df: Counter(r[0] for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).collect())
    assert text(got) == text(plain)


def test_hot_keys_are_found_exactly_and_are_few(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("lk"))
    right = spark.range(3_000).select((F.col("id") % 1_000).alias("rk"))
    hot, nl, nr = hot_keys(left, "lk", right, "rk", 16)
    assert (nl, nr) == (20_000, 3_000)
    assert [tuple(r) for r in hot.collect()] == [(-1, 10_000, 0)]
    hot, *_ = hot_keys(left, "lk", right, "rk", BUCKETS // 4)
    assert hot.count() <= 2 * (BUCKETS // 4)


def test_the_largest_task_holds_a_bounded_share_of_a_key_with_half_the_rows(spark):
    """A full outer join, one key with half the rows of the left side; rows of equal values too."""
    left = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("lk"), F.lit(1).alias("a"),
                                               F.col("id").alias("n"))
    right = spark.range(0, 2_000, 1, 2).select(F.col("id").alias("rk"), F.lit(2).alias("b"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "32", "false")):
        spark.conf.set(k, v)
    try:
        sizes = {}
        for name, df in {"split": join_split(left, right, "lk", "rk", "full_outer"),
                         "plain": left.join(right, F.col("lk").eqNullSafe(F.col("rk")), "full_outer")}.items():
            part = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes[name] = max(r["count"] for r in part) / sum(r["count"] for r in part)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sizes["plain"] > 0.45 and sizes["split"] < 0.2


def test_merge_tables_splits_joins_on_request(spark):
    left, right = (df.withColumnRenamed(c, "k") for df, c in zip(frames(spark, 1), ("lk", "rk")))
    for how in ("inner", "left", "right", "outer"):
        assert bag(merge_tables(left, right, "k", how, split_hot=True)) == bag(merge_tables(left, right, "k", how, split_hot=False))
