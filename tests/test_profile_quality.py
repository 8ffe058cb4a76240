import pytest
from pyspark.sql import functions as F

from tersus.plans import profile as prof
from tersus.plans import quality as ql
from tersus.sources import TableSet, append, preview


def test_duplicate_count(spark):
    data = [(1, None), (1, None), (None, 1), (1, None), (2, "x"), (2, "x"), (3, "y")]
    df = spark.createDataFrame(data, "`a.b` long, b string")
    assert prof.duplicate_count(df, "t").first()["duplicate_count"] == 3
    flipped = spark.createDataFrame([(1, None), (None, 1)], "a long, b long")
    assert prof.duplicate_count(flipped, "t").first()["duplicate_count"] == 0


def test_null_counts_and_issue_list(spark):
    a = spark.createDataFrame([(1, None, float("nan")), (1, None, 1.0)], "x long, y string, z double")
    b = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    nc = {r["column_name"]: (r["null_count"], r["row_count"]) for r in prof.null_counts(a, "a").collect()}
    assert nc == {"x": (0, 2), "y": (2, 2), "z": (1, 2)}
    issues = [r["issue"] for r in prof.issue_list(TableSet({"a": a, "b": b})).orderBy("rank").collect()]
    assert issues == ["a.y: 2 nulls", "a.z: 1 nulls", "b.k: 1 nulls", "b: 1 duplicates"]


def test_issue_list_caps_at_twelve(spark):
    cols = ", ".join(f"c{i} string" for i in range(15))
    df = spark.createDataFrame([tuple([None] * 15)], cols)
    assert prof.issue_list(TableSet({"t": df})).count() == 12


def test_profile_all_has_dtype_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "x long, y string")
    p = prof.profile_all(TableSet({"t": df})).collect()
    assert {(r["column_name"], r["dtype"], r["duplicate_count"]) for r in p} == {("x", "bigint", 1), ("y", "string", 1)}


def test_scorecard_null_fixing_weights(spark):
    clean = spark.createDataFrame([(30, 100.0), (40, 200.0)], "age long, salary double")
    dirty = spark.createDataFrame([("30", None), ("N/A", 200.0)], "age string, salary double")
    assert ql.scorecard_null_fixing(clean, clean).first()["score"] == 0.98
    row = ql.scorecard_null_fixing(dirty, clean).first()
    # age: 0 nulls (markers are not nulls) .30; not integral-parseable -> 0; median 30 vs 35 -> 0
    # salary: 1 null -> .07; double -> .10
    assert (row["age_nulls"], row["age_type"], row["age_median"], row["salary_nulls"], row["salary_type"]) == \
        (0.30, 0.0, 0.0, 0.07, 0.10)
    assert row["score"] == pytest.approx(0.47)


def test_scorecard_stream_empty_and_clamp(spark):
    empty = spark.createDataFrame([], "amount string, category string, region string, event_ts string")
    assert ql.scorecard_stream(empty).first()["score"] == 0.05


def test_quality_delta(spark):
    a = spark.range(1).select(F.lit(0.9).alias("score"))
    b = spark.range(1).select(F.lit(0.5).alias("score"))
    assert ql.quality_delta(a, b).first()["delta"] == 0.4


def test_preview_and_append(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, "b")], "k long, v string")
    p = preview(df, "k", 2).collect()
    assert [r["row_json"] for r in p] == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}']
    batch = spark.createDataFrame([("9", "z", "extra")], "k string, v string, w string")
    out = append(df, batch)
    assert out.count() == 4 and out.schema["k"].dataType.typeName() == "long"


def test_sinks_round_trip(spark, tmp_path):
    from tersus.sources import write_table, write_tables
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k long, v string, p string")
    write_table(df, str(tmp_path / "t"), partition_by="p")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r["k"], r["v"], r["p"]) for r in back.collect()) == [(1, "a", "x"), (2, None, "y")]
    paths = write_tables(TableSet({"a": df, "b": df.limit(1)}), str(tmp_path / "set"), fmt="json")
    assert spark.read.json(paths["b"]).count() == 1


def test_operators_on_an_empty_table(spark):
    from tersus.errors import CleaningError
    from tersus.operators import fill_nulls, filter_outliers, remove_duplicates
    empty = spark.createDataFrame([], "o long, a string, k long")
    assert remove_duplicates(empty).count() == 0
    assert remove_duplicates(empty, ["k"], order_by="o").count() == 0
    assert filter_outliers(empty, "a", "iqr", 1.5).count() == 0
    assert filter_outliers(empty, "a", "zscore", 3.0).count() == 0
    assert fill_nulls(empty, "a", "ffill", order_by="o").count() == 0
    rows = prof.null_counts(empty, "e").collect()
    assert {(r["column_name"], r["null_count"], r["row_count"]) for r in rows} == {("o", 0, 0), ("a", 0, 0), ("k", 0, 0)}
    assert prof.duplicate_count(empty, "e").first()["duplicate_count"] == 0
    with pytest.raises(CleaningError):
        fill_nulls(empty, "a", "mean")  # nothing to fit: refused, not invented


def test_append_keeps_new_columns(spark):
    out = append(spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([("2", "new")], "k string, `e.x` string"))
    assert out.columns == ["k", "v", "e.x"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", None), (2, None, "new")]


def test_empty_merged_table_scores_the_floor(spark):
    some = spark.createDataFrame([("1", "30", 2024)], "amount string, age string, order_year int")
    assert ql.scorecard_etl({"merged": some.limit(0)}, some).first()["score"] == 0.05
