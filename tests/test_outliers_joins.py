import numpy as np
import pandas as pd
import pytest

from tersus.errors import CleaningError
from tersus.functions.stats import FitBatch
from tersus.operators import filter_outliers, filter_range, merge_tables
from pyspark.sql import functions as F


def test_iqr_keeps_nulls_and_unparseable(spark):
    vals = [str(v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 1000]] + [None, "oops"]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    out = [r["a"] for r in filter_outliers(df, "a", "iqr", 1.5).collect()]
    assert "1000" not in out and None in out and "oops" in out and len(out) == 10
    assert filter_outliers(df, "a", "iqr", 1.5).schema["a"].dataType.typeName() == "string"


def test_zscore_zero_std_drops_all_non_null(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "a double")
    assert filter_outliers(df, "a", "zscore", 3.0).count() == 1
    one = spark.createDataFrame([(5.0,)], "a double")
    assert filter_outliers(one, "a", "zscore", 3.0).count() == 0


def test_unknown_method(spark):
    df = spark.createDataFrame([(5.0,)], "a double")
    with pytest.raises(CleaningError):
        filter_outliers(df, "a", "mad")


def test_fixed_range(spark):
    df = spark.createDataFrame([(v,) for v in ["-1", "5", "20000", None]], "a string")
    assert sorted(r["a"] or "" for r in filter_range(df, "a", 0, 10000).collect()) == ["", "5"]


def quantiles(df, probs, x=None):
    b = FitBatch(df)
    b.quantile("q", F.col("x") if x is None else x, probs)
    return b.run()["q"]


@pytest.mark.parametrize("hot", [1.0, 42.0, 100.0, 1e6])
def test_exact_quantiles_match_numpy_next_to_a_hot_value(spark, hot):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 3000).round(3), np.full(1500, hot)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(3)
    probs = [0.25, 0.5, 2 / 3, 0.75]
    assert np.allclose(quantiles(df, probs), [float(np.quantile(vals, p)) for p in probs], rtol=0, atol=1e-9)


@pytest.mark.parametrize("at", [0.25, 0.5, 0.75])
def test_hot_value_that_begins_at_the_quantile_itself(spark, at):
    n = 4001
    first = int(at * (n - 1))
    vals = [float(i) if i < first else (float(first) if i < first + n // 5 else float(i)) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert quantiles(df, [0.25, 0.5, 0.75]) == [float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75)]


def test_median_of_millions_of_distinct_values_next_to_a_hot_one(spark):
    n = 8_000_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") / 2 - n / 4 + 0.25).alias("x"))
    # odd ids give n/2 distinct values, symmetric about zero; even ids give zero
    assert quantiles(df, [0.5]) == [0.0]
    half = df.where("x != 0").groupBy().agg(F.min("x"), F.max("x")).first()
    low, high = quantiles(df, [0.0, 1.0])
    assert (low, high) == (half[0], half[1])


def test_several_weighted_quantiles_in_one_batch(spark):
    from tersus.functions.stats import exact_quantiles
    df = spark.createDataFrame([(1.0, 3, None), (2.0, 1, 5.0), (4.0, 2, 6.0)], "x double, n long, y double")
    got = exact_quantiles(df, [(F.col("x"), [0.5]), (F.col("y"), [0.0, 1.0]), (F.lit(None), [0.5])], weight=F.col("n"))
    assert got == [[float(np.median([1, 1, 1, 2, 4, 4]))], [5.0, 6.0], [None]]


def test_join_null_keys_match_and_suffixes(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k long, v string")
    inner = merge_tables(left, right, "k")
    assert inner.columns == ["k", "v_x", "v_y"]
    assert sorted(inner.collect(), key=str) == sorted([(1, "a", "x"), (None, "b", "y")], key=str)
    outer = merge_tables(left, right, "k", "outer")
    assert sorted(r["k"] for r in outer.collect() if r["k"] is not None) == [1, 2, 3]
    assert outer.count() == 4
    plain = merge_tables(left, right, "k", null_keys_match=False)
    assert plain.count() == 1
    right_j = merge_tables(left, right, "k", "right")
    assert sorted(r["k"] for r in right_j.collect() if r["k"] is not None) == [1, 3]


def test_join_argument_checks(spark):
    left = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(CleaningError):
        merge_tables(left, left, "zz")
    with pytest.raises(CleaningError):
        merge_tables(left, left, "k", "cross")


@pytest.mark.parametrize("vals", [
    [5.0] * 40,                                  # all equal
    [7.0],                                       # one value
    [1.0, 2.0],                                  # two values
    [float(i % 4) for i in range(101)],          # heavy ties
    [float(i) for i in range(1, 60)] + [1e9],    # far outlier
])
def test_exact_quantile_edges_match_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    want = [float(np.quantile(vals, p)) for p in probs]
    assert np.allclose(quantiles(df, probs), want, rtol=0, atol=1e-9)


def test_quantile_of_empty_column_is_none(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    b = FitBatch(df)
    b.quantile("q", F.col("x"), [0.5])
    assert b.run()["q"] == [None]


def test_approx_iqr_differs_from_exact_only_near_the_fences(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(1000, 200, 20000), rng.uniform(20000, 90000, 300)]).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    exact = {r[0] for r in filter_outliers(df, "x", "iqr", 1.5).collect()}
    approx = {r[0] for r in filter_outliers(df, "x", "iqr", 1.5, approx=True).collect()}
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    for v in exact ^ approx:
        assert min(abs(v - lo), abs(v - hi)) < 0.01 * (q3 - q1)
    assert len(exact ^ approx) <= 20


def test_join_rejects_text_against_numeric_key(spark):
    left = spark.createDataFrame([("1",)], "k string")
    right = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(CleaningError, match="cast one side"):
        merge_tables(left, right, "k")
    ints = spark.createDataFrame([(1,)], "k int")
    assert merge_tables(ints, right, "k").count() == 1  # int vs bigint widens


def test_quantiles_over_all_magnitudes_and_infinities(spark):
    import random
    r = random.Random(8)
    vals = [r.choice([-1, 1]) * 10 ** r.uniform(-320, 308) for _ in range(3000)] + [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308] * 9
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "x double").repartition(5)
    want = sorted(vals)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    ranks = [p * (len(want) - 1) for p in probs]
    got = quantiles(df, probs)
    for g, at in zip(got, ranks):
        assert want[int(at)] <= g <= want[-int(-at // 1)]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert quantiles(ends, [0.0, 0.5, 1.0]) == [float("-inf"), 1.0, float("inf")]


def test_quantile_passes_narrow_large_ranges(spark, monkeypatch):
    """Ranges of more values than a pass counts one by one are cut into parts first."""
    from tersus.functions import stats
    monkeypatch.setattr(stats, "BUCKETS", 8)
    vals = [100 + (i * 7919 % 4000) / 1000 for i in range(4000)] + [101.5] * 700
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    assert np.allclose(quantiles(df, [0.01, 0.25, 0.5, 0.99]), np.quantile(vals, [0.01, 0.25, 0.5, 0.99]), rtol=0, atol=1e-9)


def test_quantile_counts_come_with_the_passes(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,), ("1e300",)], "x string")
    b = FitBatch(df)
    b.quantile("q", F.expr("try_cast(x AS double)"), [0.5], present=F.col("x"))
    b.quantile("a", F.expr("try_cast(x AS double)"), [0.5], present=F.col("x"), approx=True)
    res = b.run()
    assert (res["q"], res["q.values"], res["q.present"], res["q.range"]) == ([2.0], 3, 4, (1.0, 1e300))
    assert (res["a.values"], res["a.present"], res["a.range"]) == (3, 4, (1.0, 1e300))


def test_quantile_passes_work_the_values_out_once(spark):
    from tersus.functions.stats import FitBatch
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rng = np.random.default_rng(3)
    x = rng.normal(size=200_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).mapInArrow(count, "x double")
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    b = FitBatch(df)
    b.quantile("q", F.col("x"), [0.25, 0.75])
    assert np.allclose(b.run()["q"], np.quantile(x, [0.25, 0.75]))
    assert seen.value == len(x)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept  # and lets them go


def test_etl_scorecard_counts_the_golden_rows_once(spark):
    from tersus.plans.quality import scorecard_etl
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = [(i, float(i % 97), i % 60, 2020 + i % 4) for i in range(1000)]
    m = spark.createDataFrame(rows, "order_id long, amount double, age long, order_year int")
    golden = m.where("order_id < 950").mapInArrow(count, m.schema)
    card = scorecard_etl({"merged": m}, golden).first()
    assert seen.value == 950 and card["row_count"] == 0.15 and card["outliers"] == 0.25


def test_date_texts_are_the_formatters(spark):
    from tersus.sources import fixtures as fx
    days = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-05 03:04:09.5'), (timestamp_ntz'0031-12-31 23:00:00'), "
                     "(timestamp_ntz'+12024-02-03 00:00:00'), (NULL) AS t(d)")
    got = days.select(fx._ymd(F.col("d")), fx._ymd(F.col("d"), "/", day_first=True), fx._ymd_hms(F.col("d"))).collect()
    want = days.selectExpr("format_string('%04d-%02d-%02d', year(d), month(d), day(d))", "format_string('%02d/%02d/%04d', day(d), month(d), year(d))",
                           "format_string('%04d-%02d-%02d %02d:%02d:%02d', year(d), month(d), day(d), hour(d), minute(d), second(d))").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
