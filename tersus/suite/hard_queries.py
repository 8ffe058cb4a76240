"""Suite queries over views that hold what the plain dirty views avoid: every marker, odd numbers and
timestamps, integers beyond 2^53, NULL keys on both sides of a join, partial score tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tersus.errors import CleaningError
from tersus.functions.parse import NULL_MARKERS, std_nulls, to_double, to_timestamp
from tersus.functions.stats import FitBatch
from tersus.operators import add_derived_column, cast_column, fill_nulls, merge_tables, normalize_values, unmapped_values
from tersus.plans import profile as prof
from tersus.plans import quality as ql
from tersus.plans import recipes as rc
from tersus.sources import append
from tersus.suite import sql as S
from tersus.suite.registry import ctx, query, r6
from tersus.suite.sql import k1, k3, with_views

# Text as it stands in the views, and what the parsers make of it.
NUMBERS = {" 12.5 ": 12.5, "1e3": 1000.0, "-7": -7.0, "+8": 8.0, ".5": 0.5, "5.": 5.0, "inf": float("inf"), "1d": None,
           "0x1p3": None, "12,5": None, "NaN": None, "\t3": 3.0}
TIMES = {"T10:20:30": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT10:20:30", "10:20:30"), " 10:20": (None, "%Y-%m-%d 10:20", "10:20:00"),
         "T10:20": (None, "%Y-%m-%dT10:20", "10:20:00"), " 10:20:30.5": (None, "%Y-%m-%d 10:20:30.5", "10:20:30.5"),
         "T10:20:30.123456": (None, "%Y-%m-%dT10:20:30.123456", "10:20:30.123456"), "T10:20:30Z": (None, "%Y-%m-%dT10:20:30Z", "10:20:30"),
         "T10:20:30+02:00": (None, "%Y-%m-%dT10:20:30+02:00", "08:20:30"), "T10:20:30.5-0130": (None, "%Y-%m-%dT10:20:30.5-0130", "11:50:30.5"),
         " noon": (None, "%Y-%m-%d noon", None)}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cases(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _number(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST('{x}' AS DOUBLE)"


_NUMBER_TEXT = _cases("o_orderkey", [_quoted(n) for n in NUMBERS])
_MARKER_TEXT = _cases("o_orderkey", [*[_quoted(m) for m in NULL_MARKERS], "' N/A'", "'Null'", "'x'"])
_DAY = "31/02/2021"


@query("k1_odd_numbers", f"SELECT o_orderkey AS order_id, {_NUMBER_TEXT} AS amount, "
       f"{_cases('o_orderkey', [_number(v) for v in NUMBERS.values()])} AS amount_num FROM orders")
def k1_odd_numbers(spark, sf):
    o = ctx(spark, sf).base["orders"].select(F.col("o_orderkey").alias("order_id"), F.expr(_NUMBER_TEXT.replace("\t", "\\t")).alias("amount"))
    return o.withColumn("amount_num", to_double("amount", o.schema["amount"].dataType))


@query("k3_all_markers", "SELECT o_orderkey AS order_id, " + _cases(
    "o_orderkey", [*["CAST(NULL AS VARCHAR)"] * len(NULL_MARKERS), "' N/A'", "'Null'", "'x'"]) + " AS mark FROM orders")
def k3_all_markers(spark, sf):
    o = ctx(spark, sf).base["orders"].select(F.col("o_orderkey").alias("order_id"), F.expr(_MARKER_TEXT).alias("mark"))
    return o.withColumn("mark", std_nulls("mark", o.schema["mark"].dataType))


_TIME_SQL = _cases("o_orderkey", [f"strftime(o_orderdate, {_quoted(f)})" for _, f, _ in TIMES.values()] + [_quoted(_DAY)])
_TIME_VALUE = _cases("o_orderkey", ["CAST(NULL AS TIMESTAMP)" if t is None else f"CAST(strftime(o_orderdate, '%Y-%m-%d {t}') AS TIMESTAMP)"
                                    for _, _, t in TIMES.values()] + ["CAST(NULL AS TIMESTAMP)"])


def _times(spark, sf):
    from tersus.sources.fixtures import _ymd
    o = ctx(spark, sf).base["orders"]
    k, day = F.col("o_orderkey") % (len(TIMES) + 1), _ymd(F.col("o_orderdate"))
    text = F.lit(_DAY)
    for i, tail in enumerate(TIMES):
        text = F.when(k == i, F.concat(day, F.lit(tail))).otherwise(text)
    return o.select(F.col("o_orderkey").alias("order_id"), text.alias("made_at"))


@query("k2_odd_timestamps", f"SELECT o_orderkey AS order_id, {_TIME_SQL} AS made_at, {_TIME_VALUE} AS made_ts FROM orders")
def k2_odd_timestamps(spark, sf):
    t = _times(spark, sf)
    return t.withColumn("made_ts", to_timestamp("made_at", t.schema["made_at"].dataType))


@query("c4_x1_odd_timestamps", f"SELECT o_orderkey AS order_id, {_TIME_VALUE} AS made_at, CAST(year({_TIME_VALUE}) AS INTEGER) "
       "AS made_year FROM orders")
def c4_x1_odd_timestamps(spark, sf):
    t = add_derived_column(_times(spark, sf), "made_year", "made_at", "year_from_date")
    return cast_column(t, "made_at", "datetime")


_BIG = 9_007_199_254_740_993


@query("c1_x4_big_ints", f"SELECT o_orderkey AS order_id, o_orderkey + {_BIG} AS as_text, o_orderkey + {_BIG} AS as_long, "
       f"o_orderkey + {_BIG} AS absolute, CASE WHEN o_orderkey % 5 = 0 THEN {_BIG} ELSE o_orderkey + {_BIG} END AS filled FROM orders")
def c1_x4_big_ints(spark, sf):
    """Integers beyond 2^53 through the int cast (from text and long), abs and a fill."""
    big = F.col("o_orderkey") + F.lit(_BIG)
    o = ctx(spark, sf).base["orders"].select(
        F.col("o_orderkey").alias("order_id"), F.concat(F.lit(" "), big.cast("string")).alias("as_text"), big.alias("as_long"),
        (-big).alias("absolute"), F.when(F.col("o_orderkey") % 5 != 0, big).alias("filled"))
    o = cast_column(cast_column(o, "as_text", "int"), "as_long", "int")
    o = add_derived_column(o, "absolute", "absolute", "abs")
    return fill_nulls(o, "filled", "constant", _BIG)


_ODD = ("SELECT o_orderkey AS order_id, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'inf' WHEN 3 THEN '1e300' "
        "WHEN 4 THEN 'some' ELSE CAST(o_orderkey AS VARCHAR) END AS v, CASE WHEN o_orderkey % 8 < 5 THEN NULL ELSE o_orderkey END AS w FROM orders")


def _odd_numbers(spark, sf):
    key = F.col("o_orderkey")
    odd = F.when(key % 8 == 1, "N/A").when(key % 8 == 2, "inf").when(key % 8 == 3, "1e300").when(key % 8 == 4, "some")
    return ctx(spark, sf).base["orders"].select(key.alias("order_id"), F.when(key % 8 != 0, F.coalesce(odd, key.cast("string"))).alias("v"),
                                                F.when(key % 8 >= 5, key).alias("w"))


@query("r0_odd_numbers", f"SELECT c.name AS column_name, b.name AS way, c.refused FROM (SELECT 'v' AS name, count(*) FILTER (WHERE "
       f"abs(TRY_CAST(v AS DOUBLE)) >= 9223372036854775808.0) > 0 AS refused FROM ({_ODD}) UNION ALL SELECT 'w', count(*) FILTER (WHERE "
       f"abs(w) >= 9223372036854775808.0) > 0 FROM ({_ODD})) c, (SELECT unnest(['batched', 'one by one', 'direct']) AS name) b")
def r0_odd_numbers(spark, sf):
    """A median fill, then an int cast: infinite and huge values are refused however the steps run, plain ones never."""
    df, out = _odd_numbers(spark, sf), []
    for c in ("v", "w"):
        steps = [{"operation": "fill_nulls", "column": c, "strategy": "median"}, {"operation": "cast_column", "column": c, "dtype": "int"}]
        ways = {"batched": lambda: rc.apply_steps({"main": df}, steps), "one by one": lambda: rc.apply_steps({"main": df}, steps, batch_fits=False),
                "direct": lambda: cast_column(fill_nulls(df, c, "median"), c, "int")}
        for way, run in ways.items():
            try:
                run()
                out.append((c, way, False))
            except CleaningError:
                out.append((c, way, True))
    return spark.createDataFrame(out, "column_name string, way string, refused boolean")


@query("n3_mode_of_big_ints", f"WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN {_BIG} - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END END AS qty "
       "FROM orders) SELECT o_orderkey AS order_id, coalesce(qty, (SELECT mode(qty) FROM t)) AS qty FROM t")
def n3_mode_of_big_ints(spark, sf):
    """Neighbouring integers beyond 2^53, one double both, are counted apart."""
    key = F.col("o_orderkey")
    o = ctx(spark, sf).base["orders"].select(key.alias("order_id"), F.when(key % 5 != 0, F.lit(_BIG) - (key % 3 == 0).cast("long")).alias("qty"))
    return fill_nulls(o, "qty", "mode")


@query("n1_fill_whole_column", "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE o_orderkey + "
       f"{_BIG} END AS qty FROM orders")
def n1_fill_whole_column(spark, sf):
    """A whole-number fill leaves a long column a long column, exactly."""
    o = ctx(spark, sf).base["orders"].select(F.col("o_orderkey").alias("order_id"), F.when(
        F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") + F.lit(_BIG)).alias("qty"))
    return fill_nulls(o, "qty", "constant", 7)


@query("n9_unfillable", with_views(" UNION ALL ".join(
    f"SELECT '{s}' AS strategy, (SELECT count({k1('none')}) FROM (SELECT CASE WHEN amount IS NULL THEN 'N/A' ELSE 'NaN' END AS none "
    f"FROM stream_dirty)) = 0 AS refused" for s in ("mean", "median", "mode")), "stream_dirty"))
def n9_unfillable(spark, sf):
    """A column of markers only has nothing to fill with: every fitted strategy must refuse."""
    s = ctx(spark, sf).stream.select(F.when(F.col("amount").isNull(), "N/A").otherwise("NaN").alias("none"))
    out = []
    for strategy in ("mean", "median", "mode"):
        try:
            fill_nulls(s, "none", strategy)
            out.append((strategy, False))
        except CleaningError:
            out.append((strategy, True))
    return spark.createDataFrame(out, "strategy string, refused boolean")


S.VIEWS["keys_left"] = ("SELECT CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 40 END AS k, count(*) AS n_left FROM orders GROUP BY 1")
S.VIEWS["keys_right"] = ("SELECT CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 60 END AS k, count(*) AS n_right FROM customer GROUP BY 1")


@query("j1_j4_null_keys", with_views(" UNION ALL ".join(
    f"SELECT '{how}' AS how, coalesce(l.k, r.k) AS k, n_left, n_right FROM keys_left l {sql} JOIN keys_right r ON l.k IS NOT DISTINCT FROM r.k"
    for how, sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER"))), "keys_left", "keys_right"))
def j1_j4_null_keys(spark, sf):
    """NULL keys on both sides match each other in every kind of join."""
    base = ctx(spark, sf).base
    def keys(t, c, drop, mod, name):
        return base[t].groupBy(F.when(F.col(c) % drop != 0, F.col(c) % mod).alias("k")).agg(F.count(F.lit(1)).alias(name))
    left, right = keys("orders", "o_custkey", 4, 40, "n_left"), keys("customer", "c_custkey", 6, 60, "n_right")
    parts = [merge_tables(left, right, "k", how).select(F.lit(how).alias("how"), "k", "n_left", "n_right") for how in ("inner", "left", "right", "outer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("v5_unicode_classes", r"SELECT p_partkey AS part_id, concat('[', p_name, ']', chr(10), '[été]') AS name FROM part")
def v5_unicode_classes(spark, sf):
    """Python's regex: ``\\w`` matches any letter, ``\\n`` in a replacement is a line feed, ``\\Z`` the very end."""
    p = ctx(spark, sf).base["part"].select(F.col("p_partkey").alias("part_id"), F.concat("p_name", F.lit("|été")).alias("name"))
    return normalize_values(p, "name", "regex", r"^([\w ]+)\|(?P<last>\w+)\Z", r"[\1]\n[\g<last>]")


@query("n_dotted_names", with_views(
    f"SELECT txn_id AS \"id.x\", round(coalesce({k1('amount')}, 0), 6) AS \"a.b\", upper(region) AS \"r c\" FROM stream_dirty "
    "WHERE category IS NOT NULL", "stream_dirty"))
def n_dotted_names(spark, sf):
    """Column names with dots and spaces through fill, normalise and drop."""
    s = ctx(spark, sf).stream.select(F.col("txn_id").alias("id.x"), F.col("amount").alias("a.b"), F.col("region").alias("r c"),
                                     F.col("category").alias("c.d"))
    out = rc.apply_steps({"main": s}, [{"operation": "fill_nulls", "column": "a.b", "strategy": "constant", "value": 0},
                                       {"operation": "normalize_values", "column": "r c", "method": "upper"},
                                       {"operation": "drop_nulls", "column": "c.d"}])["main"]
    return out.select("`id.x`", F.round(F.col("`a.b`"), 6).alias("a.b"), "`r c`")


@query("s5_append_new_column", with_views(
    "SELECT txn_id, customer_id, amount, category, region, event_ts, CASE WHEN arrival_day > DATE '2024-01-15' THEN arrival_day END AS arrival_day "
    "FROM stream_dirty_days", "stream_dirty_days"))
def s5_append_new_column(spark, sf):
    s = ctx(spark, sf).stream_days
    early = s.where(F.col("arrival_day") <= F.lit("2024-01-15").cast("date")).drop("arrival_day")
    return append(early, s.where(F.col("arrival_day") > F.lit("2024-01-15").cast("date")))


# ------------------------------------------------------------------ metrics between their extremes
@query("q1_q6_q9_partial_tiers", """
    WITH c AS (SELECT c_custkey - min(c_custkey) OVER () AS place FROM customer),
    t AS (SELECT count(*) FILTER (WHERE place < 3) AS nulls, count(*) FILTER (WHERE place < 4) AS dups, count(*) / floor(count(*) * 0.75) AS ratio FROM c)
    SELECT 'nulls' AS metric, CASE WHEN nulls = 0 THEN 0.15 WHEN nulls <= 3 THEN 0.07 ELSE 0 END AS score FROM t
    UNION ALL SELECT 'duplicates', CASE WHEN dups = 0 THEN 0.25 WHEN dups < 5 THEN 0.12 ELSE 0 END FROM t
    UNION ALL SELECT 'rows', CASE WHEN ratio BETWEEN 0.85 AND 1.15 THEN 0.15 WHEN ratio BETWEEN 0.5 AND 1.5 THEN 0.07 ELSE 0 END FROM t""")
def q1_q6_q9_partial_tiers(spark, sf):
    """Three nulls, four duplicates and a row ratio outside the narrow band earn the partial weights."""
    c = ctx(spark, sf).base["customer"].select("c_custkey", "c_acctbal")
    least = c.agg(F.min("c_custkey")).first()[0]
    few = c.withColumn("c_acctbal", F.when(F.col("c_custkey") >= least + 3, F.col("c_acctbal")))
    nulls = few.agg(ql.completeness_tier(ql.null_count(few, "c_acctbal"), *ql.G1_W["salary_nulls"]).alias("s")).first()["s"]
    dups = prof.duplicate_count(c.unionByName(c.where(F.col("c_custkey") < least + 4))).first()["duplicate_count"]
    rows = c.agg(ql.row_ratio_score(F.count(F.lit(1)), int(c.count() * 0.75), ql.G2_W["row_count"]).alias("s")).first()["s"]
    return spark.createDataFrame([("nulls", nulls), ("duplicates", ql.duplicate_tier(dups, *ql.G2_W["duplicates"])), ("rows", rows)],
                                 "metric string, score double")


@query("q4_q8_q11_partial", "SELECT bool_and(o_totalprice = trunc(o_totalprice)) AS whole, "
       f"round(avg(CAST({_TIME_VALUE} IS NOT NULL AS DOUBLE)), 6) AS parseable, "
       "round(avg(CAST(year(o_orderdate) + 27 BETWEEN 2020 AND 2025 AS DOUBLE)), 6) AS in_range FROM orders")
def q4_q8_q11_partial(spark, sf):
    o = ctx(spark, sf).base["orders"]
    t = o.select("o_totalprice", (F.year("o_orderdate") + 27).cast("double").alias("year"), "o_orderkey", "o_orderdate")
    t = t.join(_times(spark, sf).withColumnRenamed("order_id", "o_orderkey"), "o_orderkey")
    return t.agg(ql.integral_values(t, "o_totalprice").alias("whole"), r6(ql.parseable_ts_fraction(t, "made_at")).alias("parseable"),
                 r6(ql.range_validity(F.col("year"), 2020, 2025)).alias("in_range"))


@query("q5_medians_differ", "SELECT d, CASE WHEN d < 1 THEN 0.2 WHEN d < 5 THEN 0.1 ELSE 0.0 END AS score FROM (SELECT "
       "round(abs(median(l_quantity) - median(CASE WHEN l_linenumber > m THEN l_quantity END)), 6) AS d "
       "FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS m) GROUP BY m) UNION ALL SELECT 3.5, 0.1 UNION ALL SELECT 8.0, 0.0")
def q5_medians_differ(spark, sf):
    li = ctx(spark, sf).base["lineitem"]
    b = FitBatch(li)
    b.quantile("all", F.col("l_quantity"), [0.5])
    for m in range(4):
        b.quantile(m, F.when(F.col("l_linenumber") > m, F.col("l_quantity")), [0.5])
    res = b.run()
    base = res["all"][0]
    pairs = [(base, res[m][0]) for m in range(4)] + [(base, base + 3.5), (base, base - 8.0)]
    return spark.createDataFrame([(round(abs(a - e), 6), ql.median_drift_score(a, e, *ql.G1_W["age_median"])) for a, e in pairs],
                                 "d double, score double")


@query("o1_iqr_approx", with_views(
    "SELECT probability, count(v) AS n_values, TRUE AS within_error FROM (SELECT " + k1("amount") + " AS v FROM orders_dirty_base), "
    "(SELECT unnest([0.25, 0.75]) AS probability) GROUP BY probability", "orders_dirty_base"))
def o1_iqr_approx(spark, sf):
    """The approximate bounds' ranks lie within n / accuracy of the exact ones."""
    accuracy = 10_000
    o = ctx(spark, sf).orders_base
    num = to_double("amount", o.schema["amount"].dataType)
    b = FitBatch(o)
    b.quantile("q", num, [0.25, 0.75], approx=True, accuracy=accuracy)
    b.agg("n", F.count(num))
    res = b.run()
    parts = []
    for p, v in zip((0.25, 0.75), res["q"]):
        lo, hi = F.count_if(num < F.lit(v)), F.count_if(num <= F.lit(v))
        slack = res["n"] / accuracy + 1
        parts.append(o.agg(F.lit(p).alias("probability"), F.count(num).alias("n_values"),
                           ((lo <= p * res["n"] + slack) & (hi >= p * res["n"] - slack)).alias("within_error")))
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------------------ R0: all operations from JSON
_R0 = """[
 {"operation": "merge_tables", "left_table": "orders", "right_table": "customers", "on": "customer_id", "how": "left", "output_table": "merged"},
 {"operation": "remove_duplicates", "table_name": "merged", "subset": ["customer_id"], "keep": "last", "order_by": "order_id"},
 {"operation": "filter_outliers", "table_name": "merged", "column": "amount", "method": "iqr", "threshold": 1.5},
 {"operation": "fill_nulls", "table_name": "merged", "column": "amount", "strategy": "mean", "round_to": 1},
 {"operation": "add_derived_column", "column_name": "amount_abs", "source_column": "amount", "transform": "abs"},
 {"operation": "fill_nulls", "table_name": "merged", "column": "age", "strategy": "median", "integral": true},
 {"operation": "cast_column", "table_name": "merged", "column": "age", "dtype": "int"},
 {"operation": "normalize_values", "table_name": "merged", "column": "priority", "method": "upper"},
 {"operation": "cast_column", "table_name": "merged", "column": "order_date", "dtype": "datetime", "formats": ["dd/MM/yyyy"]},
 {"operation": "drop_nulls", "table_name": "merged", "column": "status"},
 {"operation": "submit"}]"""
S.VIEWS.update({
    "r0_d": "SELECT o.*, c.name, c.age, c.country FROM orders_dirty_base o LEFT JOIN customers_dirty c "
            "ON o.customer_id IS NOT DISTINCT FROM c.customer_id "
            "QUALIFY row_number() OVER (PARTITION BY o.customer_id ORDER BY order_id DESC) = 1",
    "r0_q": f"SELECT quantile_cont({k1('amount')}, 0.25) AS q1, quantile_cont({k1('amount')}, 0.75) AS q3 FROM r0_d",
    "r0_f": f"SELECT r0_d.* FROM r0_d, r0_q q WHERE {k1('amount')} IS NULL OR {k1('amount')} BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) "
            "AND q.q3 + 1.5 * (q.q3 - q.q1)",
    "r0_fit": f"SELECT round(avg({k1('amount')}), 1) AS m, trunc(median({k1('age')})) AS a FROM r0_f",
})
S._DEPS.update({"r0_d": ["orders_dirty_base", "customers_dirty"], "r0_q": ["r0_d"], "r0_f": ["r0_d", "r0_q"], "r0_fit": ["r0_f"]})


@query("r0_all_operations", with_views(
    f"SELECT order_id, customer_id, round(coalesce({k1('amount')}, m), 6) AS amount, try_strptime(order_date, '%d/%m/%Y') AS order_date, "
    f"upper({S.strip('priority')}) AS priority, status, name, CAST(trunc(coalesce({k1('age')}, a)) AS BIGINT) AS age, country, "
    f"round(abs(coalesce({k1('amount')}, m)), 6) AS amount_abs FROM r0_f, r0_fit WHERE {k3('status')} IS NOT NULL", "r0_f", "r0_fit"))
def r0_all_operations(spark, sf):
    """Every operation of a step spec, from JSON."""
    c = ctx(spark, sf)
    out = rc.apply_steps({"orders": c.orders_base, "customers": c.customers}, rc.load_steps(_R0))["merged"]
    return out.withColumn("amount", r6("amount")).withColumn("amount_abs", r6("amount_abs"))


_HOT = "CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN NULL ELSE user_id END"


@query("j4_outer_hot_keys", f"SELECT coalesce(l.k, r.k) AS k, l.event_id, r.name FROM (SELECT event_id, {_HOT} AS k FROM events) l FULL OUTER JOIN "
       "(SELECT CASE WHEN c_custkey = 2 THEN NULL ELSE c_custkey END AS k, c_name AS name FROM customer) r ON l.k IS NOT DISTINCT FROM r.k")
def j4_outer_hot_keys(spark, sf):
    """A quarter of the left rows each have a key with a partner, one without, and none (NULL, which has a partner)."""
    base, key = ctx(spark, sf).base, F.col("event_id") % 4
    left = base["events"].select(F.when(key == 0, 1).when(key == 1, -1).when(key == 3, F.col("user_id")).alias("k"), "event_id")
    right = base["customer"].select(F.when(F.col("c_custkey") != 2, F.col("c_custkey")).alias("k"), F.col("c_name").alias("name"))
    return merge_tables(left, right, "k", "outer", split_hot=True)


_SYNONYMS = ("SELECT c_custkey AS customer_id, CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN concat(' N', n_nationkey, ' ') "
             "WHEN 3 THEN concat('n', n_nationkey) WHEN 4 THEN concat('other ', c_custkey % 7) END AS country, n_name AS golden "
             "FROM customer JOIN nation ON c_nationkey = n_nationkey")
_KNOWN = "lower(trim(country)) IN (SELECT lower(n_name) FROM nation UNION SELECT concat('n', n_nationkey) FROM nation)"


def _countries(spark, sf):
    """Customers whose country is written in several ways, or unknown, or missing; and the mapping of names and codes."""
    base = ctx(spark, sf).base
    name, code, key = F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("c_custkey")
    written = (F.when(key % 6 == 0, name).when(key % 6 == 1, F.lower(name)).when(key % 6 == 2, F.concat(F.lit(" N"), code, F.lit(" ")))
               .when(key % 6 == 3, F.concat(F.lit("n"), code)).when(key % 6 == 4, F.concat(F.lit("other "), (key % 7).cast("string"))))
    rows = base["customer"].join(base["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("customer_id"), written.alias("country"))
    names = base["nation"].select(F.explode(F.array(name, F.concat(F.lit("N"), code))).alias("seen"), name.alias("name"))
    return rows, names


@query("v7_map_values", f"SELECT customer_id, CASE WHEN country IS NULL THEN NULL WHEN {_KNOWN} THEN golden ELSE country END AS country FROM ({_SYNONYMS})")
def v7_map_values(spark, sf):
    """Synonyms mapped in a step list, after copies of the rows are dropped; the mapping is a table of the set."""
    rows, names = _countries(spark, sf)
    return rc.apply_steps({"main": rows.unionByName(rows), "names": names}, [
        {"operation": "remove_duplicates", "table_name": "main"},
        {"operation": "map_values", "column": "country", "mapping": "names", "value": "seen", "canonical": "name", "table_name": "main"}])["main"]


@query("v7_unmapped_values", f"SELECT country AS value, count(*) AS n FROM ({_SYNONYMS}) WHERE country IS NOT NULL AND NOT {_KNOWN} GROUP BY 1")
def v7_unmapped_values(spark, sf):
    rows, names = _countries(spark, sf)
    return unmapped_values(rows, "country", names, "seen", "name", broadcast_bytes=0)
