import math

from pyspark.sql import functions as F

from tersus.functions.parse import is_mostly_numeric, std_nulls, to_double, to_timestamp


def test_numeric_parse_edge_cases(spark):
    vals = ["", " 12.5 ", "1e3", "inf", "1_000", "NaN", "1d", "2.5F", "0x1p3", "abc", None, "-3"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_double("s", df.schema["s"].dataType)).collect()]
    assert got[0] is None and got[1] == 12.5 and got[2] == 1000.0 and math.isinf(got[3])
    assert got[4] is None and got[5] is None and got[6] is None and got[7] is None and got[8] is None
    assert got[9] is None and got[10] is None and got[11] == -3.0


def test_numeric_parse_typed_columns(spark):
    df = spark.createDataFrame([(1.5, 2), (float("nan"), None)], "d double, i long")
    got = df.select(to_double("d", df.schema["d"].dataType).alias("d"),
                    to_double("i", df.schema["i"].dataType).alias("i")).collect()
    assert got[0]["d"] == 1.5 and got[0]["i"] == 2.0
    assert got[1]["d"] is None and got[1]["i"] is None


def test_timestamp_formats(spark):
    vals = ["2024-03-10 02:30:00", "2024-01-05", "2024/01/31", "05/03/2024", "31/02/2024", "junk", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_timestamp("s", df.schema["s"].dataType)).collect()]
    assert str(got[0]) == "2024-03-10 02:30:00"
    assert str(got[1]) == "2024-01-05 00:00:00"
    assert str(got[2]) == "2024-01-31 00:00:00"
    assert str(got[3]) == "2024-03-05 00:00:00"  # day first
    assert got[4] is None and got[5] is None and got[6] is None
    assert df.select(to_timestamp("s", df.schema["s"].dataType)).schema[0].dataType.typeName() == "timestamp_ntz"


def test_null_markers_exact_match(spark):
    vals = ["N/A", "n/a", "null", "NULL", "None", "none", "missing", "", "NaN", "nan", "n/A", " NULL ", "x", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(std_nulls("s", df.schema["s"].dataType)).collect()]
    assert got[:10] == [None] * 10
    assert got[10:] == ["n/A", " NULL ", "x", None]


def test_mostly_numeric_rule():
    assert is_mostly_numeric(6, 10) and not is_mostly_numeric(5, 10) and not is_mostly_numeric(0, 0)


def test_hex_guard_keeps_plain_zero(spark):
    df = spark.createDataFrame([("0",), ("0.5",), ("10",)], "s string")
    got = [r[0] for r in df.select(to_double(F.col("s"), df.schema["s"].dataType)).collect()]
    assert got == [0.0, 0.5, 10.0]


def test_the_default_formats_are_cast_not_formatted(spark, capsys):
    """A cast reads them several times as fast, and takes what the formatter takes, no more."""
    good = {"2024-02-29 23:59:59": "2024-02-29 23:59:59", "2024/02/29": "2024-02-29 00:00:00", "29/02/2024": "2024-02-29 00:00:00",
            "0000-01-01": "0000-01-01 00:00:00", "2024-01-01 10:00:00+02:00": "2024-01-01 08:00:00",
            "2024-01-01T10:00:00.5-0330": "2024-01-01 13:30:00.5", "2024-01-01 10:00Z": "2024-01-01 10:00:00"}
    bad = ["2023-02-29", "31/04/2024", "2024/13/01", "2024-01-01 24:00:00", "2024-01-01 23:59:60", "2024-1-1", "2024-01-01\n", " 2024-01-01",
           "2024-01-01 10:00:00.1234567", "2024-01-01T10", "2024-01-01 10:00:00 UTC", "+2024-01-01", "unknown", ""]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string")
    cast = df.select("t", to_timestamp("t", df.schema["t"].dataType).cast("string").alias("v"))
    assert {r["t"]: r["v"] for r in cast.collect()} == {**good, **dict.fromkeys([*bad, None])}
    capsys.readouterr()
    cast.explain()
    assert "gettimestamp" not in capsys.readouterr().out.lower()
