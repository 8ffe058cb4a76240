"""
an independent DuckDB statement over the same base tables (``oracle``).

Every query reads whole base tables (through the dirty views of
``tersus.sources.fixtures``); nothing is sampled or capped. Double outputs are
rounded to 6 decimals on both sides so float summation order cannot differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersus.functions.parse import std_nulls, to_double, to_timestamp
from tersus.operators import (add_derived_column, cast_column, drop_nulls, fill_nulls, filter_outliers,
                              filter_range, merge_tables, normalize_values, remove_duplicates)
from tersus.sources import fixtures as fx
from tersus.sources.readers import load_tables
from tersus.suite.sql import k1, k2, k3, strip, with_views

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


class Ctx:
    """Base tables and dirty views of one scale-factor folder (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def base(self):
        return load_tables(self.spark, self.sf_dir)

    @cached_property
    def orders_base(self) -> DataFrame:
        return fx.orders_dirty_base(self.base["orders"])

    @cached_property
    def orders(self) -> DataFrame:
        return fx.orders_dirty(self.base["orders"])

    @cached_property
    def customers(self) -> DataFrame:
        return fx.customers_dirty(self.base["customer"], self.base["nation"])

    @cached_property
    def stream(self) -> DataFrame:
        return fx.stream_dirty(self.base["events"])

    @cached_property
    def stream_days(self) -> DataFrame:
        return fx.stream_dirty(self.base["events"], with_day=True)

    @cached_property
    def people(self) -> DataFrame:
        return fx.people_dirty(self.base["customer"])

    @cached_property
    def parts(self) -> DataFrame:
        return fx.parts_dirty(self.base["part"])


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    """A fresh set of lazy tables: no query sees what an earlier one read or staged."""
    return Ctx(spark, sf_dir)


def r6(c):
    return F.round(c, 6)


def _mode_sql(expr: str, view: str, extra_where: str = "TRUE") -> str:
    return (f"(SELECT v FROM (SELECT {expr} AS v, count(*) AS c FROM {view} WHERE {expr} IS NOT NULL "
            f"AND {extra_where} GROUP BY 1) ORDER BY c DESC, v ASC LIMIT 1)")


# ------------------------------------------------------------------ K: parsers
@query("k1_parse_numeric", with_views(
    f"SELECT txn_id, amount, {k1('amount')} AS amount_num FROM stream_dirty", "stream_dirty"))
def k1_parse_numeric(spark, sf):
    s = ctx(spark, sf).stream
    return s.select("txn_id", "amount", to_double("amount", s.schema["amount"].dataType).alias("amount_num"))


@query("k2_parse_timestamp", with_views(
    f"SELECT txn_id, event_ts, {k2('event_ts')} AS event_time FROM stream_dirty", "stream_dirty"))
def k2_parse_timestamp(spark, sf):
    s = ctx(spark, sf).stream
    return s.select("txn_id", "event_ts", to_timestamp("event_ts", s.schema["event_ts"].dataType).alias("event_time"))


@query("k3_null_markers", with_views(
    f"SELECT order_id, {k3('amount')} AS amount, {k3('status')} AS status FROM orders_dirty_base",
    "orders_dirty_base"))
def k3_null_markers(spark, sf):
    o = ctx(spark, sf).orders_base
    return o.select("order_id", std_nulls("amount", o.schema["amount"].dataType).alias("amount"),
                    std_nulls("status", o.schema["status"].dataType).alias("status"))


_K4_COLS = ["amount", "order_date", "priority", "status"]


@query("k4_mostly_numeric", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({k1(c)}) AS numeric_count, count({k3(c)}) AS non_null_count, "
    f"count({k1(c)}) > 0.5 * count({k3(c)}) AS is_numeric FROM orders_dirty_base" for c in _K4_COLS),
    "orders_dirty_base"))
def k4_mostly_numeric(spark, sf):
    o = ctx(spark, sf).orders_base
    aggs = []
    for i, c in enumerate(_K4_COLS):
        dt = o.schema[c].dataType
        aggs += [F.count(to_double(c, dt)).alias(f"n{i}"), F.count(std_nulls(c, dt)).alias(f"d{i}")]
    one = o.agg(*aggs)
    stack = ", ".join(f"'{c}', n{i}, d{i}" for i, c in enumerate(_K4_COLS))
    return one.selectExpr(f"stack({len(_K4_COLS)}, {stack}) AS (column_name, numeric_count, non_null_count)") \
        .withColumn("is_numeric", F.col("numeric_count") > F.lit(0.5) * F.col("non_null_count"))


# ------------------------------------------------------------------ N: fills
@query("n1_fill_mean", with_views(
    f"SELECT order_id, round(coalesce({k1('amount')}, s.m), 6) AS amount FROM orders_dirty_base, "
    f"(SELECT avg({k1('amount')}) AS m FROM orders_dirty_base) s", "orders_dirty_base"))
def n1_fill_mean(spark, sf):
    o = fill_nulls(ctx(spark, sf).orders_base, "amount", "mean")
    return o.select("order_id", r6("amount").alias("amount"))


@query("n2_fill_median", with_views(
    f"SELECT customer_id, round(coalesce({k1('age')}, s.m), 6) AS age FROM customers_dirty, "
    f"(SELECT median({k1('age')}) AS m FROM customers_dirty) s", "customers_dirty"))
def n2_fill_median(spark, sf):
    c = fill_nulls(ctx(spark, sf).customers, "age", "median")
    return c.select("customer_id", r6("age").alias("age"))


@query("n3_fill_mode_numeric", with_views(
    f"SELECT id, round(coalesce({k1('age')}, {_mode_sql(k1('age'), 'people_dirty')}), 6) AS age "
    f"FROM people_dirty", "people_dirty"))
def n3_fill_mode_numeric(spark, sf):
    p = fill_nulls(ctx(spark, sf).people, "age", "mode")
    return p.select("id", r6("age").alias("age"))


@query("n4_fill_mode_string", with_views(
    f"SELECT txn_id, coalesce({k3('category')}, "
    f"{_mode_sql(k3('category'), 'stream_dirty', 'lower(' + k3('category') + ') <> ' + chr(39) + 'nan' + chr(39))}"
    f") AS category FROM stream_dirty", "stream_dirty"))
def n4_fill_mode_string(spark, sf):
    s = fill_nulls(ctx(spark, sf).stream, "category", "mode")
    return s.select("txn_id", "category")


@query("n5_fill_constant", with_views(
    f"SELECT txn_id, round(coalesce({k1('amount')}, 0.0), 6) AS amount, "
    f"coalesce({k3('region')}, 'Unknown') AS region, CASE WHEN {k1('amount')} IS NOT NULL THEN amount ELSE 'Unknown' END AS mixed "
    "FROM stream_dirty", "stream_dirty"))
def n5_fill_constant(spark, sf):
    """Also a constant text on a mostly numeric column, some of whose values do not parse."""
    s = ctx(spark, sf).stream.withColumn("mixed", F.col("amount"))
    s = fill_nulls(s, "amount", "constant", 0)
    s = fill_nulls(s, "region", "constant", "Unknown")
    s = fill_nulls(s, "mixed", "constant", "Unknown")
    return s.select("txn_id", r6("amount").alias("amount"), "region", "mixed")


@query("n6_forward_fill", with_views(
    f"SELECT txn_id, last_value({k3('category')} IGNORE NULLS) OVER (ORDER BY txn_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM stream_dirty", "stream_dirty"))
def n6_forward_fill(spark, sf):
    s = fill_nulls(ctx(spark, sf).stream, "category", "forward_fill", order_by="txn_id")
    return s.select("txn_id", "category")


@query("n7_backward_fill", with_views(
    f"SELECT txn_id, customer_id, first_value({k3('region')} IGNORE NULLS) OVER (PARTITION BY customer_id "
    f"ORDER BY txn_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS region FROM stream_dirty",
    "stream_dirty"))
def n7_backward_fill(spark, sf):
    s = fill_nulls(ctx(spark, sf).stream, "region", "backward_fill", order_by="txn_id",
                   partition_by=["customer_id"])
    return s.select("txn_id", "customer_id", "region")


@query("n8_numeric_fill_on_text", with_views(
    f"SELECT part_id, coalesce({k3('spec')}, CAST(s.m AS VARCHAR)) AS spec FROM parts_dirty, "
    f"(SELECT avg({k1('spec')}) AS m FROM parts_dirty) s", "parts_dirty"))
def n8_numeric_fill_on_text(spark, sf):
    p = fill_nulls(ctx(spark, sf).parts, "spec", "mean")
    return p.select("part_id", "spec")


@query("n10_drop_nulls", with_views(
    "SELECT * FROM stream_dirty WHERE amount IS NOT NULL AND category IS NOT NULL", "stream_dirty"))
def n10_drop_nulls(spark, sf):
    return drop_nulls(ctx(spark, sf).stream, ["amount", "category"])


# ------------------------------------------------------------------ C: casts
@query("c1_cast_int", with_views(
    f"SELECT customer_id, CAST(trunc(coalesce({k1('age')}, s.m)) AS BIGINT) AS age FROM customers_dirty, "
    f"(SELECT median({k1('age')}) AS m FROM customers_dirty) s", "customers_dirty"))
def c1_cast_int(spark, sf):
    c = fill_nulls(ctx(spark, sf).customers, "age", "median")
    return cast_column(c, "age", "int").select("customer_id", "age")


@query("c2_cast_float", with_views(
    f"SELECT txn_id, {k1('amount')} AS amount FROM stream_dirty", "stream_dirty"))
def c2_cast_float(spark, sf):
    return cast_column(ctx(spark, sf).stream, "amount", "float").select("txn_id", "amount")


@query("c3_cast_string", with_views(
    "SELECT CAST(id AS VARCHAR) AS id, CAST(salary AS VARCHAR) AS salary FROM people_dirty", "people_dirty"))
def c3_cast_string(spark, sf):
    p = cast_column(cast_column(ctx(spark, sf).people, "id", "str"), "salary", "str")
    return p.select("id", "salary")


@query("c4_cast_datetime", with_views(
    f"SELECT order_id, {k2('order_date')} AS order_date FROM orders_dirty_base", "orders_dirty_base"))
def c4_cast_datetime(spark, sf):
    return cast_column(ctx(spark, sf).orders_base, "order_date", "datetime").select("order_id", "order_date")


@query("c5_cast_bool", with_views(
    "SELECT order_id, length(amount) > 0 AS amount, length(status) > 0 AS status FROM orders_dirty_base",
    "orders_dirty_base"))
def c5_cast_bool(spark, sf):
    o = cast_column(cast_column(ctx(spark, sf).orders_base, "amount", "bool"), "status", "bool")
    return o.select("order_id", "amount", "status")


# ------------------------------------------------------------------ D: dedup
@query("d1_dedup_full", with_views("SELECT DISTINCT * FROM orders_dirty", "orders_dirty"))
def d1_dedup_full(spark, sf):
    return remove_duplicates(ctx(spark, sf).orders)


@query("d2_dedup_keep_first", with_views(
    "SELECT * FROM orders_dirty_base QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_id) = 1",
    "orders_dirty_base"))
def d2_dedup_keep_first(spark, sf):
    return remove_duplicates(ctx(spark, sf).orders_base, ["customer_id"], "first", order_by="order_id")


@query("d3_dedup_keep_last", with_views(
    "SELECT * FROM orders_dirty_base QUALIFY row_number() OVER (PARTITION BY customer_id "
    "ORDER BY order_id DESC) = 1", "orders_dirty_base"))
def d3_dedup_keep_last(spark, sf):
    return remove_duplicates(ctx(spark, sf).orders_base, ["customer_id"], "last", order_by="order_id")


# ------------------------------------------------------------------ V: normalise
@query("v1_upper", with_views(f"SELECT order_id, upper({strip('priority')}) AS priority FROM orders_dirty_base",
                              "orders_dirty_base"))
def v1_upper(spark, sf):
    return normalize_values(ctx(spark, sf).orders_base, "priority", "upper").select("order_id", "priority")


@query("v2_lower", with_views(f"SELECT order_id, lower({strip('priority')}) AS priority FROM orders_dirty_base",
                              "orders_dirty_base"))
def v2_lower(spark, sf):
    return normalize_values(ctx(spark, sf).orders_base, "priority", "lower").select("order_id", "priority")


@query("v3_strip", with_views(f"SELECT part_id, {strip('name')} AS name FROM parts_dirty", "parts_dirty"))
def v3_strip(spark, sf):
    return normalize_values(ctx(spark, sf).parts, "name", "strip").select("part_id", "name")


@query("v4_title", with_views(
    "SELECT part_id, array_to_string(list_transform(regexp_extract_all(" + strip("name") +
    ", '(\\p{L}+|\\P{L}+)'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS name FROM parts_dirty",
    "parts_dirty"))
def v4_title(spark, sf):
    return normalize_values(ctx(spark, sf).parts, "name", "title").select("part_id", "name")


@query("v5_regex", with_views(
    "SELECT order_id, regexp_replace(priority, '^(\\d)-(.*)$', '\\2 (\\1)') AS priority FROM orders_dirty_base",
    "orders_dirty_base"))
def v5_regex(spark, sf):
    o = normalize_values(ctx(spark, sf).orders_base, "priority", "regex", r"^(\d)-(.*)$", r"\2 (\1)")
    return o.select("order_id", "priority")


@query("v6_replace", with_views("SELECT part_id, replace(brand, 'Brand#', 'B-') AS brand FROM parts_dirty",
                                "parts_dirty"))
def v6_replace(spark, sf):
    return normalize_values(ctx(spark, sf).parts, "brand", "replace", "Brand#", "B-").select("part_id", "brand")


# ------------------------------------------------------------------ O: outliers
_IQR = "({x} IS NULL OR {x} BETWEEN q.q1 - {t} * (q.q3 - q.q1) AND q.q3 + {t} * (q.q3 - q.q1))"


@query("o1_iqr", with_views(
    "SELECT o.* FROM orders_dirty_base o, (SELECT quantile_cont(" + k1("amount") + ", 0.25) AS q1, "
    "quantile_cont(" + k1("amount") + ", 0.75) AS q3 FROM orders_dirty_base) q WHERE " +
    _IQR.format(x=k1("o.amount"), t=1.5), "orders_dirty_base"))
def o1_iqr(spark, sf):
    return filter_outliers(ctx(spark, sf).orders_base, "amount", "iqr", 1.5)


@query("o2_zscore", with_views(
    "SELECT t.* FROM stream_dirty t, (SELECT avg(" + k1("amount") + ") AS m, stddev_samp(" + k1("amount") +
    ") AS s FROM stream_dirty) z WHERE " + k1("t.amount") + " IS NULL OR coalesce(abs((" + k1("t.amount") +
    " - z.m) / z.s) <= 3.0, false)", "stream_dirty"))
def o2_zscore(spark, sf):
    return filter_outliers(ctx(spark, sf).stream, "amount", "zscore", 3.0)


@query("o3_fixed_range", with_views(
    f"SELECT * FROM stream_dirty WHERE {k1('amount')} IS NULL OR {k1('amount')} BETWEEN 0 AND 10000",
    "stream_dirty"))
def o3_fixed_range(spark, sf):
    return filter_range(ctx(spark, sf).stream, "amount", 0, 10000)


# ------------------------------------------------------------------ J: joins
@query("j1_inner", with_views(
    "SELECT o.*, c.name, c.age, c.country FROM orders_dirty_base o JOIN customers_dirty c "
    "ON o.customer_id IS NOT DISTINCT FROM c.customer_id", "orders_dirty_base", "customers_dirty"))
def j1_inner(spark, sf):
    c = ctx(spark, sf)
    return merge_tables(c.orders_base, c.customers, "customer_id", "inner")


@query("j2_left", with_views(
    "SELECT c.*, s.txn_id, s.amount, s.category, s.region, s.event_ts FROM customers_dirty c "
    "LEFT JOIN stream_dirty s ON c.customer_id IS NOT DISTINCT FROM s.customer_id",
    "customers_dirty", "stream_dirty"))
def j2_left(spark, sf):
    c = ctx(spark, sf)
    return merge_tables(c.customers, c.stream, "customer_id", "left")


@query("j3_right", with_views(
    "SELECT s.txn_id, c.customer_id, s.amount, s.category, s.region, s.event_ts, c.name, c.age, c.country "
    "FROM stream_dirty s RIGHT JOIN customers_dirty c ON s.customer_id IS NOT DISTINCT FROM c.customer_id",
    "customers_dirty", "stream_dirty"))
def j3_right(spark, sf):
    c = ctx(spark, sf)
    return merge_tables(c.stream, c.customers, "customer_id", "right")


@query("j4_outer_null_keys", with_views(
    "SELECT coalesce(l.status, r.status) AS status, l.n_lines, r.n_orders FROM "
    "(SELECT l_linestatus AS status, count(*) AS n_lines FROM lineitem GROUP BY 1) l FULL OUTER JOIN "
    "(SELECT status, count(*) AS n_orders FROM orders_dirty_base GROUP BY 1) r "
    "ON l.status IS NOT DISTINCT FROM r.status", "orders_dirty_base"))
def j4_outer_null_keys(spark, sf):
    c = ctx(spark, sf)
    lines = c.base["lineitem"].groupBy(F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = c.orders_base.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"))
    return merge_tables(lines, orders, "status", "outer")


@query("j5_overlap_suffix", with_views(
    "SELECT c.customer_id, c.name AS name_x, c.age AS age_x, c.country, p.name AS name_y, p.age AS age_y, "
    "p.salary, p.city FROM customers_dirty c JOIN people_dirty p ON c.customer_id IS NOT DISTINCT FROM p.id",
    "customers_dirty", "people_dirty"))
def j5_overlap_suffix(spark, sf):
    c = ctx(spark, sf)
    return merge_tables(c.customers, c.people.withColumnRenamed("id", "customer_id"), "customer_id", "inner")


# ------------------------------------------------------------------ X: derived
@query("x1_year_from_date", with_views(
    f"SELECT order_id, CAST(year({k2('order_date')}) AS INTEGER) AS order_year FROM orders_dirty_base",
    "orders_dirty_base"))
def x1_year_from_date(spark, sf):
    o = add_derived_column(ctx(spark, sf).orders_base, "order_year", "order_date", "year_from_date")
    return o.select("order_id", "order_year")


@query("x2_month_from_date", with_views(
    f"SELECT order_id, CAST(month({k2('order_date')}) AS INTEGER) AS order_month FROM orders_dirty_base",
    "orders_dirty_base"))
def x2_month_from_date(spark, sf):
    o = add_derived_column(ctx(spark, sf).orders_base, "order_month", "order_date", "month_from_date")
    return o.select("order_id", "order_month")


@query("x3_log1p", with_views(
    f"SELECT txn_id, round(CASE WHEN {k1('amount')} > -1 THEN ln(1 + {k1('amount')}) END, 6) AS amount_log1p "
    f"FROM stream_dirty", "stream_dirty"))
def x3_log1p(spark, sf):
    s = add_derived_column(ctx(spark, sf).stream, "amount_log1p", "amount", "log1p")
    return s.select("txn_id", r6("amount_log1p").alias("amount_log1p"))


@query("x4_abs", with_views(f"SELECT txn_id, abs({k1('amount')}) AS amount_abs FROM stream_dirty", "stream_dirty"))
def x4_abs(spark, sf):
    return add_derived_column(ctx(spark, sf).stream, "amount_abs", "amount", "abs").select("txn_id", "amount_abs")


@query("x5_len", with_views("SELECT part_id, CAST(length(name) AS INTEGER) AS name_len FROM parts_dirty",
                            "parts_dirty"))
def x5_len(spark, sf):
    return add_derived_column(ctx(spark, sf).parts, "name_len", "name", "len").select("part_id", "name_len")


@query("x6_upper", with_views("SELECT part_id, upper(name) AS name_upper FROM parts_dirty", "parts_dirty"))
def x6_upper(spark, sf):
    return add_derived_column(ctx(spark, sf).parts, "name_upper", "name", "upper").select("part_id", "name_upper")


@query("x7_lower", with_views("SELECT part_id, lower(brand) AS brand_lower FROM parts_dirty", "parts_dirty"))
def x7_lower(spark, sf):
    return add_derived_column(ctx(spark, sf).parts, "brand_lower", "brand", "lower").select("part_id", "brand_lower")


# plan-level and streaming queries register themselves on import
from tersus.suite import plan_queries  # noqa: E402,F401
from tersus.suite import stream_queries  # noqa: E402,F401
from tersus.suite import hard_queries  # noqa: E402,F401
