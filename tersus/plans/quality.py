"""Data-quality metrics Q1-Q15 and weighted scorecards G1-G4.

Every metric is one aggregate expression. A scorecard first fits what needs a
separate bounded job (exact quantiles, the duplicate count, the golden table's
row count and median) into literals, then evaluates all remaining metrics in
ONE aggregation over the table; the result is a one-row DataFrame with each
weighted component and the clamped total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tersus.functions.parse import (DATE_FORMATS, col, is_floating, is_integral, is_numeric, missing, to_double,
                                    to_timestamp)
from tersus.functions.stats import FitBatch
from tersus.plans.profile import duplicate_count

# Clamp, tiers, weights and bands of the four reference scorecards, in
# scorecard order. (full, partial) pairs are tiered weights; bands are (lo, hi, weight).
SCORE_FLOOR, SCORE_CEIL = 0.05, 0.98
NULL_TIER_MAX = 3          # at most this many nulls earns the partial weight
DUP_TIER_MAX = 5           # fewer duplicates than this earns the partial weight
FENCE = 1.5                # IQR fence multiplier of the outlier metric
G1_W = {"age_nulls": (0.30, 0.15), "age_type": (0.25, 0.12), "age_median": (0.20, 0.10),
        "median_close": (1, 5), "salary_nulls": (0.15, 0.07), "salary_type": 0.10}
G2_W = {"duplicates": (0.25, 0.12), "upper_case": 0.25, "date_type": 0.20, "date_parse_factor": 0.5,
        "amount_nulls": (0.15, 0.07), "row_count": [(0.85, 1.15, 0.15), (0.5, 1.5, 0.07)]}
G3_W = {"merged": 0.25, "outlier_cuts": (0.02, 0.10), "outliers": (0.25, 0.12), "age_nulls": (0.20, 0.10),
        "order_year": 0.15, "year_range": (2020, 2030), "row_count": [(0.80, 1.20, 0.15), (0.5, 1.5, 0.07)]}
G4_W = {"amount_nulls": 0.25, "amount_type": 0.20, "amount_parse": 0.10, "amount_parse_max_nulls": 0.10,
        "outlier_cuts": (0.03, 0.15), "outliers": (0.20, 0.10), "category_nulls": 0.15, "region_nulls": 0.10,
        "ts_type": 0.10, "null_penalty": 3}


# ----------------------------------------------------------------- helpers
def clamp(x: Column) -> Column:
    """Q14 clamp to [0.05, 0.98]. ``least`` and ``greatest`` skip NULL, so a score that cannot be computed is
    made 0 (the floor) first."""
    x = F.coalesce(x, F.lit(0.0))
    return F.greatest(F.lit(SCORE_FLOOR), F.least(F.lit(SCORE_CEIL), x))


def null_count(df: DataFrame, c: str) -> Column:
    return F.count_if(missing(df, c))


def null_fraction(df: DataFrame, c: str) -> Column:
    return F.avg(missing(df, c).cast("double"))


def completeness_tier(nulls: Column, full: float, partial: float, partial_max: int = NULL_TIER_MAX) -> Column:
    """Q1: full weight at 0 nulls, partial weight at <= partial_max nulls."""
    return F.when(nulls == 0, F.lit(full)).when(nulls <= partial_max, F.lit(partial)).otherwise(F.lit(0.0))


def completeness_prop(frac: Column, weight: float) -> Column:
    """Q2: weight * max(0, 1 - 3 * null fraction)."""
    return F.lit(weight) * F.greatest(F.lit(0.0), F.lit(1.0) - frac * G4_W["null_penalty"])


def type_kind(df: DataFrame, c: str) -> dict:
    """Q3: type conformance from the schema (no job)."""
    dt = df.schema[c].dataType
    return {"integer": is_integral(dt), "float": is_floating(dt), "numeric": is_numeric(dt),
            "datetime": isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))}


def integral_values(df: DataFrame, c: str) -> Column:
    """Q4: every row parses and has no fractional part."""
    num = to_double(c, df.schema[c].dataType)
    return (F.count(num) == F.count(F.lit(1))) & (F.count_if(num % 1 != 0) == 0)


def median_drift_score(actual, expected, full: float, half: float) -> float:
    """Q5: |median - golden median| < 1 full weight, < 5 the second weight."""
    if actual is None or expected is None:
        return 0.0
    d = abs(actual - expected)
    near, far = G1_W["median_close"]
    return full if d < near else (half if d < far else 0.0)


def duplicate_tier(dups, full: float, partial: float) -> float:
    """Q6: 0 duplicates full weight, < 5 partial."""
    return full if dups == 0 else (partial if dups < DUP_TIER_MAX else 0.0)


def upper_fraction(c: str) -> Column:
    """Q7: share of non-null values already upper case."""
    s = col(c).cast("string")
    return F.avg((s == F.upper(s)).cast("double"))


def parseable_ts_fraction(df: DataFrame, c: str, formats=DATE_FORMATS) -> Column:
    """Q8: share of all rows that parse as a timestamp."""
    return F.avg(to_timestamp(c, df.schema[c].dataType, formats).isNotNull().cast("double"))


def row_ratio_score(n: Column, n_expected: int, bands) -> Column:
    """Q9: ratio of row counts against a golden table, scored by nested bands
    ``[(lo, hi, weight), ...]`` (first matching band wins)."""
    if not n_expected:
        return F.lit(0.0)
    ratio = n / F.lit(float(n_expected))
    expr = F.lit(0.0)
    for lo, hi, w in reversed(bands):
        expr = F.when(ratio.between(F.lit(lo), F.lit(hi)), F.lit(w)).otherwise(expr)
    return expr


def iqr_bounds(q, t: float = FENCE):
    if q is None or q[0] is None:
        return None
    q1, q3 = q
    return q1 - t * (q3 - q1), q3 + t * (q3 - q1)


def outlier_fraction(num: Column, bounds) -> Column:
    """Q10: share of non-null values strictly outside the IQR fences."""
    if bounds is None:
        return F.lit(None).cast("double")
    lo, hi = bounds
    return F.avg(F.when(num.isNotNull(), ((num < F.lit(lo)) | (num > F.lit(hi))).cast("double")))


def outlier_tier(frac: Column, cuts, weights) -> Column:
    return (F.when(frac.isNull(), F.lit(0.0)).when(frac < cuts[0], F.lit(weights[0]))
            .when(frac < cuts[1], F.lit(weights[1])).otherwise(F.lit(0.0)))


def range_validity(num: Column, lo: float, hi: float) -> Column:
    """Q11: share of rows inside [lo, hi]; NULL counts as invalid."""
    return F.avg(F.coalesce(num.between(F.lit(lo), F.lit(hi)), F.lit(False)).cast("double"))


def _tagged(**named) -> DataFrame:
    """Union of one numeric column from several DataFrames, tagged by name, so
    their statistics come from one FitBatch instead of one per DataFrame."""
    parts = [df.select(F.lit(tag).alias("__t"), col.cast("double").alias("__v")) for tag, (df, col) in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quantiles(df: DataFrame, num: Column, approx: bool = False):
    b = FitBatch(df)
    b.quantile("q", num, [0.25, 0.75], approx=approx)
    return b.run()["q"]


def _total(parts: dict) -> Column:
    total = F.lit(0.0)
    for v in parts.values():
        total = total + v
    return total


def _card(df: DataFrame, parts: dict, extra: dict | None = None) -> DataFrame:
    cols = [F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()]  # no rows: nothing earned
    cols += [v.alias(k) for k, v in (extra or {}).items()]
    return df.agg(*cols).select(*[F.round(F.col(k), 6).alias(k) for k in parts],
                                *(extra or {}).keys(),
                                F.round(clamp(_total({k: F.col(k) for k in parts})), 6).alias("score"))


# -------------------------------------------------------------- scorecards
def scorecard_null_fixing(df: DataFrame, expected: DataFrame, age: str = "age",
                          salary: str = "salary") -> DataFrame:
    """G1: age nulls .30/.15; age integer .25 (or all-integral values .12); median
    against golden .20/.10; salary nulls .15/.07; salary float .10."""
    w = G1_W
    parts = {}
    if age in df.columns:
        parts["age_nulls"] = completeness_tier(null_count(df, age), *w["age_nulls"])
        if type_kind(df, age)["integer"]:
            parts["age_type"] = F.lit(w["age_type"][0])
        else:
            parts["age_type"] = F.when(integral_values(df, age), F.lit(w["age_type"][1])).otherwise(F.lit(0.0))
        med = None
        if age in expected.columns:
            both = _tagged(a=(df, to_double(age, df.schema[age].dataType)),
                           e=(expected, to_double(age, expected.schema[age].dataType)))
            b = FitBatch(both)
            v, t = F.col("__v"), F.col("__t")
            b.quantile("a", F.when(t == "a", v), [0.5])
            b.quantile("e", F.when(t == "e", v), [0.5])
            res = b.run()
            med = median_drift_score(res["a"][0], res["e"][0], *w["age_median"])
        parts["age_median"] = F.lit(med or 0.0)
    else:
        parts["age_nulls"] = F.lit(0.0)
    if salary in df.columns:
        parts["salary_nulls"] = completeness_tier(null_count(df, salary), *w["salary_nulls"])
        parts["salary_type"] = F.lit(w["salary_type"] if type_kind(df, salary)["float"] else 0.0)
    else:
        parts["salary_nulls"] = F.lit(0.0)
    return _card(df, parts)


def scorecard_normalisation(df: DataFrame, expected: DataFrame, dirty: DataFrame | None = None,
                            country: str = "country", date: str = "order_date",
                            amount: str = "amount") -> DataFrame:
    """G2: duplicates .25/.12; upper-case share x.25; date typed .20 or parseable
    share x.20x.5; amount nulls .15/.07; row ratio [.85,1.15] .15, [.5,1.5] .07."""
    dups = duplicate_count(df, "t").first()["duplicate_count"]
    n_exp = expected.count()
    w = G2_W
    parts = {"duplicates": F.lit(duplicate_tier(dups, *w["duplicates"]))}
    if country in df.columns:
        parts["upper_case"] = F.lit(w["upper_case"]) * F.coalesce(upper_fraction(country), F.lit(0.0))
    if date in df.columns:
        if type_kind(df, date)["datetime"]:
            parts["date_type"] = F.lit(w["date_type"])
        else:
            parts["date_type"] = F.lit(w["date_type"] * w["date_parse_factor"]) * parseable_ts_fraction(df, date)
    if amount in df.columns:
        parts["amount_nulls"] = completeness_tier(null_count(df, amount), *w["amount_nulls"])
    parts["row_count"] = row_ratio_score(F.count(F.lit(1)), n_exp, w["row_count"])
    return _card(df, parts)


def scorecard_etl(tables, expected: DataFrame, dirty=None, amount: str = "amount", age: str = "age",
                  year: str = "order_year", year_range=G3_W["year_range"], approx: bool = False) -> DataFrame:
    """G3: merged table present .25; residual IQR outliers <.02 .25, <.10 .12; age
    nulls .20/.10; year validity share x.15; row ratio [.8,1.2] .15, [.5,1.5] .07."""
    key = next((k for k in ("merged", "main") if k in tables), None)
    if key is None:
        return expected.agg(F.lit(SCORE_FLOOR).alias("score"))
    m = tables[key]
    w = G3_W
    parts = {"merged": F.lit(w["merged"])}
    has_amount = amount in m.columns
    num = to_double(amount, m.schema[amount].dataType) if has_amount else F.lit(None).cast("double")
    n_exp = expected.count()
    if has_amount:
        bounds = iqr_bounds(_quantiles(m, num, approx))
        parts["outliers"] = outlier_tier(outlier_fraction(num, bounds), w["outlier_cuts"], w["outliers"])
    if age in m.columns:
        parts["age_nulls"] = completeness_tier(null_count(m, age), *w["age_nulls"])
    if year in m.columns:
        yr = to_double(year, m.schema[year].dataType)
        parts["order_year"] = F.lit(w["order_year"]) * range_validity(yr, *year_range)
    parts["row_count"] = row_ratio_score(F.count(F.lit(1)), n_exp, w["row_count"])
    return _floor_if_empty(_card(m, parts, {"n_rows": F.count(F.lit(1))}))


def _floor_if_empty(card: DataFrame) -> DataFrame:
    return card.withColumn("score", F.when(F.col("n_rows") == 0, F.lit(SCORE_FLOOR)).otherwise(F.col("score"))).drop("n_rows")


def scorecard_stream(df: DataFrame, amount: str = "amount", category: str = "category",
                     region: str = "region", ts: str = "event_ts", approx: bool = False) -> DataFrame:
    """G4: amount completeness x.25; numeric type .20 (or null share <.10: .10);
    IQR outliers <.03 .20, <.15 .10; category x.15 and region x.10 completeness;
    timestamp typed .10 or parseable share x.10. Empty table: 0.05."""
    w = G4_W
    parts = {}
    if amount in df.columns:
        num = to_double(amount, df.schema[amount].dataType)
        frac = F.avg(num.isNull().cast("double"))
        parts["amount_nulls"] = completeness_prop(frac, w["amount_nulls"])
        if type_kind(df, amount)["numeric"]:
            parts["amount_type"] = F.lit(w["amount_type"])
        else:
            parts["amount_type"] = F.when(frac < w["amount_parse_max_nulls"], F.lit(w["amount_parse"])) \
                .otherwise(F.lit(0.0))
        bounds = iqr_bounds(_quantiles(df, num, approx))
        parts["outliers"] = outlier_tier(outlier_fraction(num, bounds), w["outlier_cuts"], w["outliers"])
    if category in df.columns:
        parts["category_nulls"] = completeness_prop(null_fraction(df, category), w["category_nulls"])
    if region in df.columns:
        parts["region_nulls"] = completeness_prop(null_fraction(df, region), w["region_nulls"])
    if ts in df.columns:
        if type_kind(df, ts)["datetime"]:
            parts["ts_type"] = F.lit(w["ts_type"])
        else:
            parts["ts_type"] = F.lit(w["ts_type"]) * parseable_ts_fraction(df, ts)
    return _floor_if_empty(_card(df, parts, {"n_rows": F.count(F.lit(1))}))


def quality_delta(after: DataFrame, before: DataFrame) -> DataFrame:
    """Q15: score(after) - score(before), rounded to 4. ``before`` is a one-row
    scorecard; its score is fetched as a literal."""
    sb = before.select("score").first()["score"]
    return after.select(F.lit(sb).alias("score_before"), F.col("score").alias("score_after"),
                        F.round(F.col("score") - F.lit(sb), 4).alias("delta"))
