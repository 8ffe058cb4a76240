"""Suite queries for sources (S), profiling (P), metrics (Q), scorecards (G) and recipes (R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tersus.functions.parse import to_double
from tersus.operators import filter_outliers, normalize_values, remove_duplicates
from tersus.plans import profile as prof
from tersus.plans import quality as ql
from tersus.plans import recipes as rc
from tersus.sources import append, preview
from tersus.sources.catalog import TableSet
from tersus.sources.readers import TABLES
from tersus.suite import sql as S
from tersus.suite.registry import ctx, query, r6
from tersus.suite.sql import k1, k2, k3, strip, with_views


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _iqr_keep(x: str, q: str) -> str:
    return f"({x} IS NULL OR {x} BETWEEN {q}.q1 - 1.5 * ({q}.q3 - {q}.q1) AND {q}.q3 + 1.5 * ({q}.q3 - {q}.q1))"


def _mode(expr: str, view: str, extra: str = "TRUE") -> str:
    return (f"(SELECT v FROM (SELECT {expr} AS v, count(*) AS c FROM {view} WHERE {expr} IS NOT NULL AND {extra} "
            f"GROUP BY 1) ORDER BY c DESC, v ASC LIMIT 1)")


# ---------------------------------------------------------------- recipe CTEs (SQL side)
S.VIEWS.update({
    "r1_fit": f"SELECT median({k1('age')}) AS mage, avg({k1('salary')}) AS msal FROM people_dirty",
    "r1": f"SELECT id, name, CAST(trunc(coalesce({k1('age')}, mage)) AS BIGINT) AS age, "
          f"coalesce({k1('salary')}, msal) AS salary, city FROM people_dirty, r1_fit",
    "r7_fit": f"SELECT trunc(median({k1('age')})) AS mage, round(avg({k1('salary')}), 2) AS msal FROM people_dirty",
    "r7": f"SELECT id, name, CAST(trunc(coalesce({k1('age')}, mage)) AS BIGINT) AS age, "
          f"coalesce({k1('salary')}, msal) AS salary, city FROM people_dirty, r7_fit",
    "r2_d": "SELECT DISTINCT * FROM orders_dirty",
    "r2_fit": f"SELECT avg({k1('amount')}) AS m FROM r2_d",
    "r2": f"SELECT order_id, customer_id, coalesce({k1('amount')}, m) AS amount, {k2('order_date')} AS order_date, "
          f"upper({strip('priority')}) AS priority, status FROM r2_d, r2_fit",
    "r3_m": "SELECT o.*, c.name, c.age, c.country FROM orders_dirty_base o JOIN customers_dirty c "
            "ON o.customer_id IS NOT DISTINCT FROM c.customer_id",
    "r3_fit": f"SELECT median({k1('age')}) AS mage, quantile_cont({k1('amount')}, 0.25) AS q1, "
              f"quantile_cont({k1('amount')}, 0.75) AS q3 FROM r3_m",
    "r3": f"SELECT order_id, customer_id, amount, order_date, priority, status, name, "
          f"CAST(trunc(coalesce({k1('age')}, mage)) AS BIGINT) AS age, country, "
          f"CAST(year({k2('order_date')}) AS INTEGER) AS order_year FROM r3_m, r3_fit q "
          f"WHERE {_iqr_keep(k1('amount'), 'q')}",
    "r5_cfit": f"SELECT trunc(median({k1('age')})) AS mage FROM customers_dirty",
    "r5_c": f"SELECT customer_id, name, CAST(trunc(coalesce({k1('age')}, mage)) AS BIGINT) AS age, country "
            f"FROM customers_dirty, r5_cfit",
    "r5_m": "SELECT o.*, c.name, c.age, c.country FROM orders_dirty_base o JOIN r5_c c "
            "ON o.customer_id IS NOT DISTINCT FROM c.customer_id",
    "r5_fit": f"SELECT quantile_cont({k1('amount')}, 0.25) AS q1, quantile_cont({k1('amount')}, 0.75) AS q3 FROM r5_m",
    "r5": f"SELECT r5_m.*, CAST(year({k2('order_date')}) AS INTEGER) AS order_year FROM r5_m, r5_fit q "
          f"WHERE {_iqr_keep(k1('amount'), 'q')}",
    "r4_q": f"SELECT quantile_cont({k1('amount')}, 0.25) AS q1, quantile_cont({k1('amount')}, 0.75) AS q3 "
            f"FROM stream_dirty",
    "r4_f": f"SELECT s.* FROM stream_dirty s, r4_q q WHERE {_iqr_keep(k1('s.amount'), 'q')}",
    "r4_fit": f"SELECT avg({k1('amount')}) AS m, "
              f"{_mode(k3('category'), 'r4_f', 'lower(' + k3('category') + ") <> 'nan'")} AS mc, "
              f"{_mode(k3('region'), 'r4_f', 'lower(' + k3('region') + ") <> 'nan'")} AS mr FROM r4_f",
    "r4": f"SELECT txn_id, customer_id, coalesce({k1('amount')}, m) AS amount, coalesce({k3('category')}, mc) "
          f"AS category, coalesce({k3('region')}, mr) AS region, {k2('event_ts')} AS event_ts FROM r4_f, r4_fit",
    "r6_fit": f"SELECT round(avg(CASE WHEN {k1('amount')} BETWEEN 0 AND 10000 THEN {k1('amount')} END), 2) AS m "
              f"FROM stream_dirty",
    "r6": f"SELECT txn_id, customer_id, coalesce({k1('amount')}, m) AS amount, category, region, "
          f"{k2('event_ts')} AS event_ts FROM stream_dirty, r6_fit "
          f"WHERE coalesce({k1('amount')}, m) BETWEEN 0 AND 10000",
})
S._DEPS.update({
    "r1_fit": ["people_dirty"], "r1": ["r1_fit"], "r7_fit": ["people_dirty"], "r7": ["r7_fit"],
    "r2_d": ["orders_dirty"], "r2_fit": ["r2_d"], "r2": ["r2_fit"],
    "r3_m": ["orders_dirty_base", "customers_dirty"], "r3_fit": ["r3_m"], "r3": ["r3_fit"],
    "r5_cfit": ["customers_dirty"], "r5_c": ["r5_cfit"], "r5_m": ["orders_dirty_base", "r5_c"],
    "r5_fit": ["r5_m"], "r5": ["r5_fit"],
    "r4_q": ["stream_dirty"], "r4_f": ["r4_q"], "r4_fit": ["r4_f"], "r4": ["r4_fit"],
    "r6_fit": ["stream_dirty"], "r6": ["r6_fit"],
})


# ---------------------------------------------------------------- S: sources
@query("s1_catalog_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def s1_catalog_counts(spark, sf):
    base = ctx(spark, sf).base
    parts = [base.table(t).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s4_preview", with_views(
    "SELECT CAST(to_json({'order_id': order_id, 'customer_id': customer_id, 'amount': amount, "
    "'order_date': order_date, 'priority': priority, 'status': status}) AS VARCHAR) AS row_json, order_id "
    "FROM orders_dirty_base ORDER BY order_id LIMIT 10", "orders_dirty_base"))
def s4_preview(spark, sf):
    return preview(ctx(spark, sf).orders_base, "order_id", 10)


@query("s5_append", with_views("SELECT * FROM stream_dirty", "stream_dirty"))
def s5_append(spark, sf):
    s = ctx(spark, sf).stream_days
    early = s.where(F.col("arrival_day") <= F.lit("2024-01-15").cast("date")).drop("arrival_day")
    late = s.where(F.col("arrival_day") > F.lit("2024-01-15").cast("date")).drop("arrival_day")
    return append(early, late)


# ---------------------------------------------------------------- P: profiling
_PEOPLE = [("id", "bigint"), ("name", "string"), ("age", "string"), ("salary", "double"), ("city", "string")]
_CUST = [("customer_id", "bigint"), ("name", "string"), ("age", "string"), ("country", "string")]
_ORD = ["order_id", "customer_id", "amount", "order_date", "priority", "status"]
_STREAM = ["txn_id", "customer_id", "amount", "category", "region", "event_ts"]


def _miss(c, dtype="string"):
    return f"({c} IS NULL OR isnan({c}))" if dtype == "double" else f"{c} IS NULL"


def _null_rows(table, view, cols):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, "
        f"count(*) FILTER (WHERE {_miss(c, t)}) AS null_count, count(*) AS row_count FROM {view}"
        for i, (c, t) in enumerate(cols))


@query("p2_null_counts", with_views(_null_rows("people", "people_dirty", _PEOPLE), "people_dirty"))
def p2_null_counts(spark, sf):
    return prof.null_counts(ctx(spark, sf).people, "people")


def _dup_sql(table, view):
    return (f"SELECT '{table}' AS table_name, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) "
            f"AS BIGINT) AS duplicate_count FROM {view}")


@query("p3_duplicate_count", with_views(_dup_sql("orders", "orders_dirty"), "orders_dirty"))
def p3_duplicate_count(spark, sf):
    return prof.duplicate_count(ctx(spark, sf).orders, "orders")


_VIEWS_P4 = [("orders_dirty", "orders"), ("customers_dirty", "customers"), ("stream_dirty", "stream"),
             ("people_dirty", "people"), ("parts_dirty", "parts")]


@query("p4_row_counts", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {v}" for v, n in _VIEWS_P4),
    *[v for v, _ in _VIEWS_P4]))
def p4_row_counts(spark, sf):
    c = ctx(spark, sf)
    dfs = {"orders": c.orders, "customers": c.customers, "stream": c.stream, "people": c.people, "parts": c.parts}
    return reduce(lambda a, b: a.unionByName(b), [
        prof.null_counts(df, n).where(F.col("ordinal") == 0).select("table_name", "row_count")
        for n, df in dfs.items()])


def _issues_sql():
    parts = []
    for ti, (table, view, cols) in enumerate([("orders", "orders_dirty", _ORD), ("stream", "stream_dirty", _STREAM),
                                              ("people", "people_dirty", [c for c, _ in _PEOPLE])]):
        types = dict(_PEOPLE) if table == "people" else {}
        for ci, c in enumerate(cols):
            cond = _miss(c, types.get(c, "string"))
            parts.append(f"SELECT {ti} AS t, {ci} AS o, '{table}.{c}: ' || count(*) FILTER (WHERE {cond}) || ' nulls' "
                         f"AS issue, count(*) FILTER (WHERE {cond}) AS n FROM {view}")
        parts.append(f"SELECT {ti} AS t, {len(cols)} AS o, '{table}: ' || d || ' duplicates' AS issue, d AS n FROM "
                     f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS d FROM {view})")
    return ("SELECT CAST(row_number() OVER (ORDER BY t, o) AS INTEGER) AS rank, issue FROM ("
            + " UNION ALL ".join(parts) + ") WHERE n > 0 ORDER BY t, o LIMIT 12")


@query("p5_issue_list", with_views(_issues_sql(), "orders_dirty", "stream_dirty", "people_dirty"))
def p5_issue_list(spark, sf):
    c = ctx(spark, sf)
    return prof.issue_list(TableSet({"orders": c.orders, "stream": c.stream, "people": c.people}))


def _profile_sql():
    parts = []
    for ti, (table, view, cols) in enumerate([("customers", "customers_dirty", _CUST),
                                              ("people", "people_dirty", _PEOPLE)]):
        for i, (c, t) in enumerate(cols):
            parts.append(
                f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, "
                f"'{t}' AS dtype, count(*) FILTER (WHERE {_miss(c, t)}) AS null_count, count(*) AS row_count, "
                f"CAST({ti} AS INTEGER) AS table_ordinal, "
                f"CAST((SELECT count(*) FROM {view}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) AS BIGINT) "
                f"AS duplicate_count FROM {view}")
    return " UNION ALL ".join(parts)


@query("p6_profile_all", with_views(_profile_sql(), "customers_dirty", "people_dirty"))
def p6_profile_all(spark, sf):
    c = ctx(spark, sf)
    return prof.profile_all(TableSet({"customers": c.customers, "people": c.people}))


# ---------------------------------------------------------------- R: recipes
@query("r1_null_fix", with_views("SELECT id, name, age, round(salary, 6) AS salary, city FROM r1", "r1"))
def r1_null_fix(spark, sf):
    return rc.r1_null_fix(ctx(spark, sf).people).withColumn("salary", r6("salary"))


@query("r2_normalise", with_views(
    "SELECT order_id, customer_id, round(amount, 6) AS amount, order_date, priority, status FROM r2", "r2"))
def r2_normalise(spark, sf):
    return rc.r2_normalise(ctx(spark, sf).orders).withColumn("amount", r6("amount"))


@query("r3_etl", with_views("SELECT * FROM r3", "r3"))
def r3_etl(spark, sf):
    c = ctx(spark, sf)
    return rc.r3_etl(c.orders_base, c.customers)


@query("r4_stream_clean", with_views(
    "SELECT txn_id, customer_id, round(amount, 6) AS amount, category, region, event_ts FROM r4", "r4"))
def r4_stream_clean(spark, sf):
    return rc.r4_stream(ctx(spark, sf).stream).withColumn("amount", r6("amount"))


@query("r5_golden_etl", with_views("SELECT * FROM r5", "r5"))
def r5_golden_etl(spark, sf):
    c = ctx(spark, sf)
    return rc.r5_golden_etl(c.orders_base, c.customers)


@query("r6_golden_stream", with_views(
    "SELECT txn_id, customer_id, round(amount, 6) AS amount, category, region, event_ts FROM r6", "r6"))
def r6_golden_stream(spark, sf):
    return rc.r6_golden_stream(ctx(spark, sf).stream).withColumn("amount", r6("amount"))


@query("r7_golden_null_fix", with_views("SELECT id, name, age, round(salary, 6) AS salary, city FROM r7", "r7"))
def r7_golden_null_fix(spark, sf):
    return rc.r7_golden_null_fix(ctx(spark, sf).people).withColumn("salary", r6("salary"))


@query("r0_step_spec", with_views(
    f"SELECT txn_id, customer_id, amount, category, region, event_ts FROM stream_dirty "
    f"WHERE amount IS NOT NULL", "stream_dirty"))
def r0_step_spec(spark, sf):
    """R0: a JSON step list compiled to one plan."""
    steps = rc.load_steps('[{"operation": "drop_nulls", "column": "amount", "table_name": "stream"}, '
                          '{"operation": "submit"}]')
    return rc.apply_steps({"stream": ctx(spark, sf).stream}, steps, default_table="stream")["stream"]


# ---------------------------------------------------------------- G: scorecards
def _clamp(expr: str) -> str:
    return f"round(greatest(0.05, least(0.98, {expr})), 6)"


def _tier(n: str, full: float, part: float) -> str:
    return f"round(CASE WHEN {n} = 0 THEN {_d(full)} WHEN {n} <= 3 THEN {_d(part)} ELSE {_d(0.0)} END, 6)"


def _sum(cols):
    return " + ".join(["0.0::DOUBLE"] + list(cols))


G1_SQL = with_views(
    "SELECT age_nulls, age_type, age_median, salary_nulls, salary_type, "
    + _clamp(_sum(["age_nulls", "age_type", "age_median", "salary_nulls", "salary_type"])) + " AS score FROM ("
    f"SELECT {_tier('n_age', 0.30, 0.15)} AS age_nulls, {_d(0.25)} AS age_type, "
    f"round(CASE WHEN abs(ma - me) < 1 THEN {_d(0.20)} WHEN abs(ma - me) < 5 THEN {_d(0.10)} ELSE {_d(0.0)} END, 6) "
    f"AS age_median, {_tier('n_sal', 0.15, 0.07)} AS salary_nulls, {_d(0.10)} AS salary_type FROM "
    "(SELECT count(*) FILTER (WHERE age IS NULL) AS n_age, count(*) FILTER (WHERE salary IS NULL OR isnan(salary)) "
    "AS n_sal, median(CAST(age AS DOUBLE)) AS ma FROM r1) a, (SELECT median(CAST(age AS DOUBLE)) AS me FROM r7) b)",
    "r1", "r7")


@query("g1_scorecard_null_fix", G1_SQL)
def g1_scorecard_null_fix(spark, sf):
    p = ctx(spark, sf).people
    return ql.scorecard_null_fixing(rc.r1_null_fix(p), rc.r7_golden_null_fix(p))


def _ratio(n: str, n_exp: str, bands) -> str:
    r = f"(CAST({n} AS DOUBLE) / CAST({n_exp} AS DOUBLE))"
    whens = " ".join(f"WHEN {r} BETWEEN {lo} AND {hi} THEN {_d(w)}" for lo, hi, w in bands)
    return f"round(CASE {whens} ELSE {_d(0.0)} END, 6)"


G2_SQL = with_views(
    "SELECT duplicates, upper_case, date_type, amount_nulls, row_count, "
    + _clamp(_sum(["duplicates", "upper_case", "date_type", "amount_nulls", "row_count"])) + " AS score FROM ("
    f"SELECT round(CASE WHEN d = 0 THEN {_d(0.25)} WHEN d < 5 THEN {_d(0.12)} ELSE {_d(0.0)} END, 6) AS duplicates, "
    f"round({_d(0.25)} * coalesce(uf, 0.0), 6) AS upper_case, {_d(0.20)} AS date_type, "
    f"{_tier('n_amt', 0.15, 0.07)} AS amount_nulls, "
    f"{_ratio('n', 'n_exp', [(0.85, 1.15, 0.15), (0.5, 1.5, 0.07)])} AS row_count FROM "
    "(SELECT count(*) AS n, count(*) FILTER (WHERE amount IS NULL OR isnan(amount)) AS n_amt, "
    "avg(CASE WHEN priority IS NOT NULL THEN CAST(priority = upper(priority) AS DOUBLE) END) AS uf, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r2)) AS d FROM r2) a, "
    "(SELECT count(*) AS n_exp FROM orders_dirty_base) b)", "r2", "orders_dirty_base")


@query("g2_scorecard_normalise", G2_SQL)
def g2_scorecard_normalise(spark, sf):
    c = ctx(spark, sf)
    return ql.scorecard_normalisation(rc.r2_normalise(c.orders), c.orders_base, c.orders, country="priority")


def _outlier_sql(num: str, view: str, cuts, weights) -> str:
    return (f"(SELECT round(CASE WHEN f IS NULL THEN {_d(0.0)} WHEN f < {cuts[0]} THEN {_d(weights[0])} "
            f"WHEN f < {cuts[1]} THEN {_d(weights[1])} ELSE {_d(0.0)} END, 6) FROM "
            f"(SELECT avg(CASE WHEN {num} IS NOT NULL THEN CAST({num} < q.q1 - 1.5 * (q.q3 - q.q1) OR "
            f"{num} > q.q3 + 1.5 * (q.q3 - q.q1) AS DOUBLE) END) AS f FROM {view}, "
            f"(SELECT quantile_cont({num}, 0.25) AS q1, quantile_cont({num}, 0.75) AS q3 FROM {view}) q))")


G3_SQL = with_views(
    "SELECT merged, outliers, age_nulls, order_year, row_count, "
    + _clamp(_sum(["merged", "outliers", "age_nulls", "order_year", "row_count"])) + " AS score FROM ("
    f"SELECT {_d(0.25)} AS merged, {_outlier_sql(k1('amount'), 'r3', (0.02, 0.10), (0.25, 0.12))} AS outliers, "
    f"{_tier('n_age', 0.20, 0.10)} AS age_nulls, round({_d(0.15)} * yv, 6) AS order_year, "
    f"{_ratio('n', 'n_exp', [(0.80, 1.20, 0.15), (0.5, 1.5, 0.07)])} AS row_count FROM "
    "(SELECT count(*) AS n, count(*) FILTER (WHERE age IS NULL) AS n_age, "
    "avg(CAST(coalesce(CAST(order_year AS DOUBLE) BETWEEN 2020 AND 2030, false) AS DOUBLE)) AS yv FROM r3) a, "
    "(SELECT count(*) AS n_exp FROM r5) b)", "r3", "r5")


@query("g3_scorecard_etl", G3_SQL)
def g3_scorecard_etl(spark, sf):
    c = ctx(spark, sf)
    merged = rc.r3_etl(c.orders_base, c.customers)
    return ql.scorecard_etl({"merged": merged}, rc.r5_golden_etl(c.orders_base, c.customers))


def _g4_sql(view: str, typed: bool) -> str:
    amt = "amount" if typed else k1("amount")
    amount_type = _d(0.20) if typed else f"CASE WHEN nf < 0.10 THEN {_d(0.10)} ELSE {_d(0.0)} END"
    ts = _d(0.10) if typed else f"round({_d(0.10)} * tf, 6)"
    ts_frac = "1.0" if typed else f"avg(CAST({k2('event_ts')} IS NOT NULL AS DOUBLE))"
    prop = "round({w} * greatest(0.0, 1.0 - {f} * 3), 6)"
    return (
        "SELECT amount_nulls, amount_type, outliers, category_nulls, region_nulls, ts_type, "
        + _clamp(_sum(["amount_nulls", "amount_type", "outliers", "category_nulls", "region_nulls", "ts_type"]))
        + " AS score FROM ("
        f"SELECT {prop.format(w=_d(0.25), f='nf')} AS amount_nulls, round({amount_type}, 6) AS amount_type, "
        f"{_outlier_sql(amt, view, (0.03, 0.15), (0.20, 0.10))} AS outliers, "
        f"{prop.format(w=_d(0.15), f='cf')} AS category_nulls, {prop.format(w=_d(0.10), f='rf')} AS region_nulls, "
        f"{ts} AS ts_type FROM (SELECT avg(CAST({amt} IS NULL AS DOUBLE)) AS nf, "
        f"avg(CAST(category IS NULL AS DOUBLE)) AS cf, avg(CAST(region IS NULL AS DOUBLE)) AS rf, "
        f"{ts_frac} AS tf FROM {view}) a)")


@query("g4_scorecard_stream", with_views(_g4_sql("r4", True), "r4"))
def g4_scorecard_stream(spark, sf):
    return ql.scorecard_stream(rc.r4_stream(ctx(spark, sf).stream))


# ---------------------------------------------------------------- Q: metrics
@query("q1_completeness_tier", with_views(
    f"SELECT 'dirty' AS stage, 'salary' AS column_name, n AS null_count, {_tier('n', 0.15, 0.07)} AS score FROM "
    "(SELECT count(*) FILTER (WHERE salary IS NULL OR isnan(salary)) AS n FROM people_dirty) UNION ALL "
    f"SELECT 'clean' AS stage, 'salary' AS column_name, n AS null_count, {_tier('n', 0.15, 0.07)} AS score FROM "
    "(SELECT count(*) FILTER (WHERE salary IS NULL OR isnan(salary)) AS n FROM r1)", "people_dirty", "r1"))
def q1_completeness_tier(spark, sf):
    p = ctx(spark, sf).people
    out = []
    for stage, df in (("dirty", p), ("clean", rc.r1_null_fix(p))):
        n = ql.null_count(df, "salary")
        out.append(df.agg(n.alias("null_count")).select(
            F.lit(stage).alias("stage"), F.lit("salary").alias("column_name"), "null_count",
            r6(ql.completeness_tier(F.col("null_count"), *ql.G1_W["salary_nulls"])).alias("score")))
    return out[0].unionByName(out[1])


@query("q2_completeness_prop", with_views(
    "SELECT 'category' AS column_name, round(f, 6) AS null_fraction, "
    f"round({_d(0.15)} * greatest(0.0, 1.0 - f * 3), 6) AS score FROM "
    "(SELECT avg(CAST(category IS NULL AS DOUBLE)) AS f FROM stream_dirty) UNION ALL "
    "SELECT 'region' AS column_name, round(f, 6) AS null_fraction, "
    f"round({_d(0.10)} * greatest(0.0, 1.0 - f * 3), 6) AS score FROM "
    "(SELECT avg(CAST(region IS NULL AS DOUBLE)) AS f FROM stream_dirty)", "stream_dirty"))
def q2_completeness_prop(spark, sf):
    s = ctx(spark, sf).stream
    out = []
    for c, w in (("category", ql.G4_W["category_nulls"]), ("region", ql.G4_W["region_nulls"])):
        f = ql.null_fraction(s, c)
        out.append(s.agg(f.alias("f")).select(F.lit(c).alias("column_name"), r6("f").alias("null_fraction"),
                                               r6(ql.completeness_prop(F.col("f"), w)).alias("score")))
    return out[0].unionByName(out[1])


_R1_TYPES = [("id", "bigint"), ("name", "string"), ("age", "bigint"), ("salary", "double"), ("city", "string")]


@query("q3_type_conformance", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {_miss(c, t)}) AS null_count, "
    f"{str(t == 'bigint').upper()} AS is_integer, {str(t == 'double').upper()} AS is_float, "
    f"{str(t in ('bigint', 'double')).upper()} AS is_numeric, FALSE AS is_datetime FROM r1"
    for c, t in _R1_TYPES), "r1"))
def q3_type_conformance(spark, sf):
    df = rc.r1_null_fix(ctx(spark, sf).people)
    p = prof.profile(df, "people")
    kinds = {c: ql.type_kind(df, c) for c in df.columns}

    def flag(k):
        return F.col("column_name").isin([c for c, v in kinds.items() if v[k]] or ["\u0000"])
    return p.select("column_name", "dtype", "null_count", flag("integer").alias("is_integer"),
                    flag("float").alias("is_float"), flag("numeric").alias("is_numeric"),
                    flag("datetime").alias("is_datetime"))


@query("q4_integral_values", with_views(
    f"SELECT all_parse, all_integral, CASE WHEN all_parse AND all_integral THEN {_d(0.12)} ELSE {_d(0.0)} END "
    f"AS score FROM (SELECT count(x) = count(*) AS all_parse, count(*) FILTER (WHERE x % 1 <> 0) = 0 AS all_integral "
    f"FROM (SELECT coalesce({k1('age')}, s.m) AS x FROM customers_dirty, "
    f"(SELECT median({k1('age')}) AS m FROM customers_dirty) s))", "customers_dirty"))
def q4_integral_values(spark, sf):
    from tersus.operators import fill_nulls
    df = fill_nulls(ctx(spark, sf).customers, "age", "median")
    num = to_double("age", df.schema["age"].dataType)
    return df.agg((F.count(num) == F.count(F.lit(1))).alias("all_parse"),
                  (F.count_if(num % 1 != 0) == 0).alias("all_integral")) \
        .withColumn("score", F.when(F.col("all_parse") & F.col("all_integral"), F.lit(ql.G1_W["age_type"][1]))
                    .otherwise(F.lit(0.0)))


@query("q5_median_drift", with_views(
    f"SELECT ma AS median_actual, me AS median_expected, CASE WHEN abs(ma - me) < 1 THEN {_d(0.20)} "
    f"WHEN abs(ma - me) < 5 THEN {_d(0.10)} ELSE {_d(0.0)} END AS score FROM "
    "(SELECT median(CAST(age AS DOUBLE)) AS ma FROM r1), (SELECT median(CAST(age AS DOUBLE)) AS me FROM r7)",
    "r1", "r7"))
def q5_median_drift(spark, sf):
    from tersus.functions.stats import FitBatch
    p = ctx(spark, sf).people
    a, e = rc.r1_null_fix(p), rc.r7_golden_null_fix(p)
    fa, fe = FitBatch(a), FitBatch(e)
    fa.quantile("m", F.col("age").cast("double"), [0.5])
    fe.quantile("m", F.col("age").cast("double"), [0.5])
    ma, me = fa.run()["m"][0], fe.run()["m"][0]
    return a.agg(F.lit(ma).cast("double").alias("median_actual"), F.lit(me).cast("double").alias("median_expected"),
                 F.lit(ql.median_drift_score(ma, me, *ql.G1_W["age_median"])).alias("score"))


@query("q6_duplicate_tier", with_views(
    f"SELECT 'dirty' AS stage, d AS duplicate_count, CASE WHEN d = 0 THEN {_d(0.25)} WHEN d < 5 THEN {_d(0.12)} "
    f"ELSE {_d(0.0)} END AS score FROM ({_dup_sql('x', 'orders_dirty').replace('AS duplicate_count', 'AS d')}) "
    f"UNION ALL SELECT 'deduplicated' AS stage, d AS duplicate_count, CASE WHEN d = 0 THEN {_d(0.25)} "
    f"WHEN d < 5 THEN {_d(0.12)} ELSE {_d(0.0)} END AS score FROM "
    f"({_dup_sql('x', 'r2_d').replace('AS duplicate_count', 'AS d')})", "orders_dirty", "r2_d"))
def q6_duplicate_tier(spark, sf):
    o = ctx(spark, sf).orders
    out = []
    for stage, df in (("dirty", o), ("deduplicated", remove_duplicates(o))):
        d = prof.duplicate_count(df, stage)
        out.append(d.select(F.col("table_name").alias("stage"), "duplicate_count",
                            F.when(F.col("duplicate_count") == 0, F.lit(ql.G2_W["duplicates"][0]))
                            .when(F.col("duplicate_count") < ql.DUP_TIER_MAX, F.lit(ql.G2_W["duplicates"][1]))
                            .otherwise(F.lit(0.0)).alias("score")))
    return out[0].unionByName(out[1])


@query("q7_upper_fraction", with_views(
    "SELECT 'dirty' AS stage, round(f, 6) AS upper_fraction, round(0.25 * f, 6) AS score FROM "
    "(SELECT avg(CASE WHEN priority IS NOT NULL THEN CAST(priority = upper(priority) AS DOUBLE) END) AS f "
    "FROM orders_dirty_base) UNION ALL SELECT 'normalised' AS stage, round(f, 6) AS upper_fraction, "
    "round(0.25 * f, 6) AS score FROM (SELECT avg(CASE WHEN p IS NOT NULL THEN CAST(p = upper(p) AS DOUBLE) END) "
    f"AS f FROM (SELECT upper({strip('priority')}) AS p FROM orders_dirty_base))", "orders_dirty_base"))
def q7_upper_fraction(spark, sf):
    o = ctx(spark, sf).orders_base
    out = []
    for stage, df in (("dirty", o), ("normalised", normalize_values(o, "priority", "upper"))):
        out.append(df.agg(ql.upper_fraction("priority").alias("f")).select(
            F.lit(stage).alias("stage"), r6("f").alias("upper_fraction"),
            r6(F.col("f") * ql.G2_W["upper_case"]).alias("score")))
    return out[0].unionByName(out[1])


@query("q8_parseable_timestamps", with_views(
    f"SELECT 'event_ts' AS column_name, round(avg(CAST({k2('event_ts')} IS NOT NULL AS DOUBLE)), 6) "
    f"AS parseable_fraction FROM stream_dirty UNION ALL SELECT 'order_date' AS column_name, "
    f"round(avg(CAST({k2('order_date')} IS NOT NULL AS DOUBLE)), 6) AS parseable_fraction FROM orders_dirty_base",
    "stream_dirty", "orders_dirty_base"))
def q8_parseable_timestamps(spark, sf):
    c = ctx(spark, sf)
    a = c.stream.agg(r6(ql.parseable_ts_fraction(c.stream, "event_ts")).alias("parseable_fraction")) \
        .select(F.lit("event_ts").alias("column_name"), "parseable_fraction")
    b = c.orders_base.agg(r6(ql.parseable_ts_fraction(c.orders_base, "order_date")).alias("parseable_fraction")) \
        .select(F.lit("order_date").alias("column_name"), "parseable_fraction")
    return a.unionByName(b)


@query("q9_row_ratio", with_views(
    f"SELECT 'dirty' AS stage, n AS n_rows, round(CAST(n AS DOUBLE) / e, 6) AS ratio, "
    f"{_ratio('n', 'e', [(0.85, 1.15, 0.15), (0.5, 1.5, 0.07)])} AS score FROM "
    "(SELECT count(*) AS n FROM orders_dirty), (SELECT count(*) AS e FROM orders_dirty_base) UNION ALL "
    f"SELECT 'deduplicated' AS stage, n AS n_rows, round(CAST(n AS DOUBLE) / e, 6) AS ratio, "
    f"{_ratio('n', 'e', [(0.85, 1.15, 0.15), (0.5, 1.5, 0.07)])} AS score FROM "
    "(SELECT count(*) AS n FROM r2_d), (SELECT count(*) AS e FROM orders_dirty_base)",
    "orders_dirty", "orders_dirty_base", "r2_d"))
def q9_row_ratio(spark, sf):
    c = ctx(spark, sf)
    n_exp = c.orders_base.count()
    out = []
    for stage, df in (("dirty", c.orders), ("deduplicated", remove_duplicates(c.orders))):
        n = F.count(F.lit(1))
        out.append(df.agg(n.alias("n_rows"), r6(n / F.lit(float(n_exp))).alias("ratio"),
                          r6(ql.row_ratio_score(n, n_exp, ql.G2_W["row_count"])).alias("score"))
                   .select(F.lit(stage).alias("stage"), "n_rows", "ratio", "score"))
    return out[0].unionByName(out[1])


def _frac_sql(num, view):
    return (f"(SELECT round(avg(CASE WHEN {num} IS NOT NULL THEN CAST({num} < q.q1 - 1.5 * (q.q3 - q.q1) OR "
            f"{num} > q.q3 + 1.5 * (q.q3 - q.q1) AS DOUBLE) END), 6) FROM {view}, "
            f"(SELECT quantile_cont({num}, 0.25) AS q1, quantile_cont({num}, 0.75) AS q3 FROM {view}) q)")


@query("q10_outlier_fraction", with_views(
    f"SELECT 'dirty' AS stage, {_frac_sql(k1('amount'), 'stream_dirty')} AS outlier_fraction, "
    f"{_outlier_sql(k1('amount'), 'stream_dirty', (0.03, 0.15), (0.20, 0.10))} AS score UNION ALL "
    f"SELECT 'filtered' AS stage, {_frac_sql(k1('amount'), 'r4_f')} AS outlier_fraction, "
    f"{_outlier_sql(k1('amount'), 'r4_f', (0.03, 0.15), (0.20, 0.10))} AS score", "stream_dirty", "r4_f"))
def q10_outlier_fraction(spark, sf):
    s = ctx(spark, sf).stream
    out = []
    for stage, df in (("dirty", s), ("filtered", filter_outliers(s, "amount", "iqr", 1.5))):
        num = to_double("amount", df.schema["amount"].dataType)
        frac = ql.outlier_fraction(num, ql.iqr_bounds(ql._quantiles(df, num)))
        out.append(df.agg(frac.alias("f")).select(
            F.lit(stage).alias("stage"), r6("f").alias("outlier_fraction"),
            r6(ql.outlier_tier(F.col("f"), ql.G4_W["outlier_cuts"], ql.G4_W["outliers"])).alias("score")))
    return out[0].unionByName(out[1])


@query("q11_range_validity", with_views(
    "SELECT round(v, 6) AS year_validity, round(0.15 * v, 6) AS score FROM "
    "(SELECT avg(CAST(coalesce(CAST(order_year AS DOUBLE) BETWEEN 2020 AND 2030, false) AS DOUBLE)) AS v FROM r3)",
    "r3"))
def q11_range_validity(spark, sf):
    c = ctx(spark, sf)
    df = rc.r3_etl(c.orders_base, c.customers)
    v = ql.range_validity(F.col("order_year").cast("double"), *ql.G3_W["year_range"])
    return df.agg(v.alias("v")).select(r6("v").alias("year_validity"),
                                       r6(F.col("v") * ql.G3_W["order_year"]).alias("score"))


@query("q13_mostly_parseable", with_views(
    f"SELECT round(f, 6) AS null_fraction, CASE WHEN f < 0.10 THEN {_d(0.10)} ELSE {_d(0.0)} END AS score FROM "
    f"(SELECT avg(CAST({k1('amount')} IS NULL AS DOUBLE)) AS f FROM stream_dirty)", "stream_dirty"))
def q13_mostly_parseable(spark, sf):
    s = ctx(spark, sf).stream
    num = to_double("amount", s.schema["amount"].dataType)
    return s.agg(F.avg(num.isNull().cast("double")).alias("f")).select(
        r6("f").alias("null_fraction"),
        F.when(F.col("f") < ql.G4_W["amount_parse_max_nulls"], F.lit(ql.G4_W["amount_parse"])).otherwise(F.lit(0.0))
        .alias("score"))


@query("q15_quality_delta", with_views(
    "SELECT b.score AS score_before, a.score AS score_after, round(a.score - b.score, 4) AS delta FROM ("
    + _g4_sql("r4", True) + ") a, (" + _g4_sql("stream_dirty", False) + ") b", "r4", "stream_dirty"))
def q15_quality_delta(spark, sf):
    s = ctx(spark, sf).stream
    return ql.quality_delta(ql.scorecard_stream(rc.r4_stream(s)), ql.scorecard_stream(s))


# ---------------------------------------------------------------- S2/S3, approx options
@query("s2_raw_json_ingest", with_views("SELECT * FROM stream_dirty", "stream_dirty"))
def s2_raw_json_ingest(spark, sf):
    """Dirty rows written as JSON and read back with the declared raw (all-string) schema."""
    from tersus.session import scratch_dir
    from tersus.sources.readers import RAW_STREAM_SCHEMA, read_raw
    path = scratch_dir(spark, "json")
    ctx(spark, sf).stream.write.json(path)
    return read_raw(spark, path, RAW_STREAM_SCHEMA, "json")


@query("s3_bind_output_table", with_views(
    "SELECT s.*, c.name, c.age, c.country, upper(c.country) AS country_upper FROM stream_dirty s "
    "JOIN customers_dirty c ON s.customer_id IS NOT DISTINCT FROM c.customer_id",
    "stream_dirty", "customers_dirty"))
def s3_bind_output_table(spark, sf):
    c = ctx(spark, sf)
    out = rc.apply_steps({"stream": c.stream, "customers": c.customers}, [
        {"operation": "merge_tables", "left_table": "stream", "right_table": "customers", "on": "customer_id",
         "output_table": "enriched"},
        {"operation": "add_derived_column", "table_name": "enriched", "column_name": "country_upper",
         "source_column": "country", "transform": "upper"},
    ])
    return out["enriched"]


# ---------------------------------------------------------------- all recipes at once
_G_SQL = {"null_fix": G1_SQL, "normalise": G2_SQL, "etl": G3_SQL, "stream": with_views(_g4_sql("r4", True), "r4")}


@query("r_all_recipe_scores", " UNION ALL ".join(
    f"SELECT '{k}' AS scenario, score FROM ({v})" for k, v in _G_SQL.items()))
def r_all_recipe_scores(spark, sf):
    """Every scenario's recipe and its scorecard, one row per scenario (the
    reference's run-all-recipes entry point; its mean is the headline score)."""
    cards = {"null_fix": g1_scorecard_null_fix, "normalise": g2_scorecard_normalise, "etl": g3_scorecard_etl,
             "stream": g4_scorecard_stream}
    parts = [fn(spark, sf).select(F.lit(k).alias("scenario"), "score") for k, fn in cards.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
