import pytest

from tersus.errors import CleaningError
from tersus.operators import cast_column, normalize_values, remove_duplicates
from tersus.functions.text import python_replacement_to_java


def test_cast_int_refuses_nulls_with_count(spark):
    df = spark.createDataFrame([("1",), ("N/A",), ("x",)], "a string")
    with pytest.raises(CleaningError, match="^2 value"):
        cast_column(df, "a", "int")


def test_cast_int_truncates_toward_zero(spark):
    df = spark.createDataFrame([(3.9,), (-3.9,)], "a double")
    assert [r["a"] for r in cast_column(df, "a", "int").collect()] == [3, -3]


def test_cast_int_lazy_fails_at_run_time(spark):
    df = spark.createDataFrame([("1",), (None,)], "a string")
    out = cast_column(df, "a", "int", check="lazy")
    with pytest.raises(Exception):
        out.collect()


def test_cast_bool_truthiness(spark):
    df = spark.createDataFrame([("abc", 0.0), ("", 2.0), (None, None)], "s string, d double")
    out = cast_column(cast_column(df, "s", "bool"), "d", "bool").collect()
    assert [(r["s"], r["d"]) for r in out] == [(True, False), (False, True), (None, None)]


def test_cast_unknown_dtype(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(CleaningError):
        cast_column(df, "a", "complex")


def test_dedup_full_is_idempotent_and_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "a long, b string")
    once = remove_duplicates(df)
    assert once.count() == 3 and remove_duplicates(once).count() == 3


def test_dedup_keep_first_last(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 5, "c"), (None, 3, "d"), (None, 4, "e")],
                               "k string, o long, v string")
    first = {r["k"]: r["v"] for r in remove_duplicates(df, ["k"], "first", order_by="o").collect()}
    last = {r["k"]: r["v"] for r in remove_duplicates(df, ["k"], "last", order_by="o").collect()}
    assert first == {"k": "a", "j": "c", None: "d"} and last == {"k": "b", "j": "c", None: "e"}


def test_dedup_keep_false_rejected(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(CleaningError):
        remove_duplicates(df, ["a"], keep=False)


def test_title_case_like_python(spark):
    vals = ["u.s.a o'neil x-y", "  hello WORLD\t", "3rd place", ""]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["s"] for r in normalize_values(df, "s", "title").collect()]
    assert got == [v.strip().title() for v in vals]


def test_upper_strip_tabs_and_null_stays_null(spark):
    df = spark.createDataFrame([("\t usa \n",), (None,)], "s string")
    assert [r["s"] for r in normalize_values(df, "s", "upper").collect()] == ["USA", None]


def test_regex_group_references(spark):
    df = spark.createDataFrame([("1-URGENT",), ("cost $5",)], "s string")
    out = [r["s"] for r in normalize_values(df, "s", "regex", r"^(\d)-(.*)$", r"\2 (\1)").collect()]
    assert out == ["URGENT (1)", "cost $5"]
    assert python_replacement_to_java(r"\g<name>-$") == r"${name}-\$"


def test_literal_replace_and_pattern_required(spark):
    df = spark.createDataFrame([("a.b.c",)], "s string")
    assert normalize_values(df, "s", "replace", ".", "-").first()["s"] == "a-b-c"
    with pytest.raises(CleaningError):
        normalize_values(df, "s", "regex")


def test_python_named_groups_translate(spark):
    import re as _re
    from tersus.functions.text import python_pattern_to_java
    pat, repl = r"(?P<num>\d)-(?P<word>\w+)", r"\g<word>:\g<num>"
    assert python_pattern_to_java(r"(?P<a>x)(?P=a)") == r"(?U)(?<a>x)\k<a>"
    df = spark.createDataFrame([("1-URGENT",), ("none",)], "s string")
    got = [r["s"] for r in normalize_values(df, "s", "regex", pat, repl).collect()]
    assert got == [_re.sub(pat, repl, "1-URGENT"), "none"]


def test_int_cast_is_exact_over_the_whole_long_range(spark):
    vals = [str(2 ** 53 + 1), str(2 ** 63 - 1), str(-2 ** 63), " +7 ", "1e3", "2.9", "-2.9"]
    df = spark.createDataFrame([(v,) for v in vals], "a string")
    assert [r["a"] for r in cast_column(df, "a", "int").collect()] == [2 ** 53 + 1, 2 ** 63 - 1, -2 ** 63, 7, 1000, 2, -2]
    for bad in (str(2 ** 63), "1e19", "inf", "x"):
        with pytest.raises(CleaningError, match="^1 value"):
            cast_column(spark.createDataFrame([(bad,)], "a string"), "a", "int")


def test_keep_first_needs_an_order_and_any_does_not(spark):
    df = spark.createDataFrame([("k", 1), ("k", 2)], "k string, o long")
    with pytest.raises(CleaningError, match="order_by"):
        remove_duplicates(df, ["k"], "last")
    assert remove_duplicates(df, ["k"], "any").count() == 1


def test_regex_escapes_and_unicode(spark):
    import re as _re
    for pat, repl, text in [(r"(\w+) (\w+)", r"\2\n\1", "été ok"), (r"\d+\Z", "#", "a1 22"), (r"\s", r"\t", "a\u00a0b c"), (r"\\Z", "z", "\\Z")]:
        df = spark.createDataFrame([(text,)], "s string")
        assert normalize_values(df, "s", "regex", pat, repl).first()["s"] == _re.sub(pat, repl, text)
