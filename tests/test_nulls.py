import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tersus.errors import CleaningError
from tersus.operators import drop_nulls, fill_nulls


def test_mean_fill_parses_and_fills(spark):
    df = spark.createDataFrame([(1, "10"), (2, "N/A"), (3, "20"), (4, None)], "id long, a string")
    out = fill_nulls(df, "a", "mean").orderBy("id")
    assert [r["a"] for r in out.collect()] == [10.0, 15.0, 20.0, 15.0]
    assert out.schema["a"].dataType.typeName() == "double"


def test_median_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, None]], "a double")
    assert sorted(r["a"] for r in fill_nulls(df, "a", "median").collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_mode_numeric_tie_smallest(spark):
    df = spark.createDataFrame([(v,) for v in ["3", "1", "3", "1", None]], "a string")
    assert sorted(r["a"] for r in fill_nulls(df, "a", "mode").collect()) == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_mode_string_excludes_nan_variants_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "NAN", "NAN", "NAN", "b", "a", None]], "a string")
    out = [r["a"] for r in fill_nulls(df, "a", "mode").collect()]
    assert out.count("a") == 3  # tie a/b -> smallest; NAN excluded from the count


def test_mode_all_null_raises(spark):
    df = spark.createDataFrame([("missing",), (None,)], "a string")
    with pytest.raises(CleaningError):
        fill_nulls(df, "a", "mode")


def test_unfillable_and_unknown(spark):
    df = spark.createDataFrame([(None,), ("N/A",)], "a string")
    with pytest.raises(CleaningError):
        fill_nulls(df, "a", "mean")
    with pytest.raises(CleaningError):
        fill_nulls(df, "a", "constant")
    with pytest.raises(CleaningError):
        fill_nulls(df, "a", "sideways")


def test_numeric_statistic_on_text_column_fills_nulls_only(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "4"), (4, None), (5, "z")], "id long, a string")
    out = {r["id"]: r["a"] for r in fill_nulls(df, "a", "mean").collect()}
    assert out == {1: "x", 2: "y", 3: "4", 4: "4.0", 5: "z"}


def test_constant_on_numeric_column_replaces_unparseable(spark):
    df = spark.createDataFrame([(1, "5"), (2, "oops"), (3, "7"), (4, "8")], "id long, a string")
    out = {r["id"]: r["a"] for r in fill_nulls(df, "a", "constant", 0).collect()}
    assert out == {1: 5.0, 2: 0.0, 3: 7.0, 4: 8.0}


def test_round_and_integral_options(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, None, 2.5]], "a double")
    assert fill_nulls(df, "a", "mean", round_to=2).where("a < 1.9 or a > 1.9").count() == 4
    vals = sorted(r["a"] for r in fill_nulls(df, "a", "median", integral=True).collect())
    assert vals == [1.0, 2.0, 2.0, 2.5]


@pytest.mark.parametrize("strategy,fn,frame", [
    ("ffill", F.last, (Window.unboundedPreceding, 0)),
    ("bfill", F.first, (0, Window.unboundedFollowing)),
])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_ordered_fill_bucketed_equals_window(spark, strategy, fn, frame, keys):
    data = [(i, None if i % 4 == 0 else i % 3, None if (i % 7 in (0, 1, 2) or 40 <= i < 80) else f"v{i}")
            for i in range(300)]
    df = spark.createDataFrame(data, "o long, g long, v string")
    got = fill_nulls(df, "v", strategy, order_by="o", partition_by=keys, buckets=7)
    w = Window.partitionBy(*keys).orderBy("o").rowsBetween(*frame)
    want = df.withColumn("v", fn("v", True).over(w))
    assert sorted(got.collect()) == sorted(want.collect())


def test_ordered_fill_needs_order(spark):
    df = spark.createDataFrame([(1, None)], "o long, v string")
    with pytest.raises(CleaningError):
        fill_nulls(df, "v", "ffill")


def test_leading_nulls_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "o long, v string")
    out = {r["o"]: r["v"] for r in fill_nulls(df, "v", "ffill", order_by="o", buckets=2).collect()}
    assert out == {1: None, 2: "a", 3: "a"}


def test_drop_nulls_treats_nan_as_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert drop_nulls(df, ["x"]).count() == 2


def test_text_constant_replaces_all_that_is_no_number(spark):
    df = spark.createDataFrame([("1",), ("2.50",), ("abc",), (None,), ("N/A",), ("3",)], "x string")
    assert [r["x"] for r in fill_nulls(df, "x", "constant", "Unknown").collect()] == ["1", "2.50", "Unknown", "Unknown", "Unknown", "3"]
    whole = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r["x"] for r in fill_nulls(whole, "x", "constant", "Unknown").collect()] == ["1", "Unknown", "3"]


def test_modes_of_longs_stay_exact(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big,), (big,), (big - 1,), (None,)], "x long")
    assert sorted(r["x"] for r in fill_nulls(df, "x", "mode").collect()) == [big - 1, big, big, big]


def test_int_cast_after_a_fill_refuses_what_no_int_can_hold(spark):
    from tersus.plans.recipes import apply_steps
    steps = [{"operation": "fill_nulls", "column": "x", "strategy": "median"}, {"operation": "cast_column", "column": "x", "dtype": "int"}]
    for odd in ("inf", "-inf", "1e300", "9223372036854775808", "abc"):
        df = spark.createDataFrame([("1",), ("2",), (odd,), (None,), ("4",)], "x string")
        for batched in (True, False):
            if odd == "abc":
                assert [r["x"] for r in apply_steps({"main": df}, steps, batch_fits=batched)["main"].collect()] == [1, 2, 2, 2, 4]
                continue
            with pytest.raises(CleaningError):
                apply_steps({"main": df}, steps, batch_fits=batched)
