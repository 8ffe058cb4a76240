"""Plan-shape checks for the scale properties the README claims."""
from tersus.operators import fill_nulls, merge_tables, remove_duplicates
from tersus.plans.profile import duplicate_count

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(i % 5, i, str(i)) for i in range(200)], "k long, o long, v string")
    p = plan(remove_duplicates(df, ["k"], "first", order_by="o"))
    partial = p.index("WindowGroupLimit")
    # the partial group limit sits below (after, in the tree text) the hash exchange on the key
    assert "Partial" in p and p.index("Exchange hashpartitioning") < p.rindex("Partial")
    assert partial >= 0


def test_ordered_fill_never_windows_all_rows_in_one_partition(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"v{i}") for i in range(500)], "o long, v string")
    p = plan(fill_nulls(df, "v", "ffill", order_by="o", buckets=8))
    # the data window is partitioned by bucket; a single partition only for the one row per bucket
    assert "hashpartitioning(__bucket" in p
    assert p.count("SinglePartition") == 1


def no_broadcast(spark, build):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_duplicate_count_is_one_scan_and_one_exchange_of_rows(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    p = no_broadcast(spark, lambda: duplicate_count(df, "orders"))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    out = df.where("o_orderkey = 5").select("o_orderkey", "o_totalprice")
    p = plan(out)
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_full_outer_join_is_one_join(spark):
    left, right = (spark.read.parquet(f"{SF}/{t}.parquet").withColumnRenamed(c, "k") for t, c in (("orders", "o_custkey"), ("customer", "c_custkey")))
    p = no_broadcast(spark, lambda: merge_tables(left, right, "k", "outer"))
    assert p.count("SortMergeJoin") == 1 and "FullOuter" in p
    assert p.count("FileScan") == 2 and p.count("Exchange hashpartitioning") == 2


def test_fits_are_literals_not_joins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)], "a double")
    p = plan(fill_nulls(df, "a", "median"))
    assert "Join" not in p and "coalesce" in p
