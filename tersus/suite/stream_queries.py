"""Suite queries for Structured Streaming (ST1-ST6).

The dirty stream view is staged as files under the session's checkpoint folder; each
query runs a real streaming query over it (``availableNow``, one file per trigger)
into a sink under the same folder and returns the sink read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tersus.plans import duplicates as dup
from tersus.plans import recipes as rc
from tersus.plans.profile import duplicate_count
from tersus.streaming import (clean_to_sink, dedup_to_sink, drift_report, drift_to_sink, fit_drift_baseline, fit_recipe,
                              forward_fill_to_sink, read_deduplicated, read_stream, running_profile, running_score)
from tersus.streaming.monitor import new_paths
from tersus.suite.registry import ctx, query, r6
from tersus.suite.sql import k1, k2, k3, with_views
from tersus.suite.staging import WRITE, stage_batches, stage_in_order

RAW_DAYS_SCHEMA = ("txn_id STRING, customer_id BIGINT, amount STRING, category STRING, region STRING, "
                   "event_ts STRING, arrival_day DATE")
STREAM_COLS = ["txn_id", "customer_id", "amount", "category", "region", "event_ts"]


def _stream(spark, sf, path=None):
    """A file stream over the staged table, one file (a fifth of it) a micro-batch."""
    path = path or stage_batches(ctx(spark, sf).stream_days, spark, "arrival_day")
    return read_stream(spark, path, RAW_DAYS_SCHEMA, max_files_per_trigger=1)


def _read_sink(spark, sink):
    return spark.read.parquet(sink).drop("batch_id")


@query("st1_stream_ingest", with_views("SELECT * FROM stream_dirty_days", "stream_dirty_days"))
def st1_stream_ingest(spark, sf):
    sink, ck = new_paths(spark, "sink", "ckpt")
    clean_to_sink(_stream(spark, sf), lambda df: df, sink, ck)
    return _read_sink(spark, sink)


@query("st2_stream_clean", with_views(
    "SELECT txn_id, customer_id, round(amount, 6) AS amount, category, region, event_ts FROM r4", "r4"))
def st2_stream_clean(spark, sf):
    fitted = fit_recipe(ctx(spark, sf).stream, rc.R4_STREAM)
    sink, ck = new_paths(spark, "sink", "ckpt")
    clean_to_sink(_stream(spark, sf), lambda df: fitted.apply(df.drop("arrival_day")), sink, ck)
    return _read_sink(spark, sink).withColumn("amount", r6("amount"))


_UNTIMED = "CAST(substr(txn_id, 5) AS BIGINT) % 11 = 3"


@query("st3_stream_dedup", with_views(
    f"SELECT * REPLACE (CASE WHEN {_UNTIMED} THEN 'unknown' ELSE event_ts END AS event_ts) FROM stream_dirty_days",
    "stream_dirty_days"))
def st3_stream_dedup(spark, sf):
    """The source delivers the days in no order (so most rows are late), some rows without a time that parses,
    and every third row a second time after all others: as it was, on another day, or without a time that parses."""
    days = ctx(spark, sf).stream_days
    days = days.withColumn("event_ts", F.when(F.expr(_UNTIMED), "unknown").otherwise(F.col("event_ts")))
    src = stage_batches(days, spark, "arrival_day")
    number = F.expr("CAST(substr(txn_id, 5) AS BIGINT)")
    again = F.when(number % 9 == 3, "1999-12-31 00:00:00").when(number % 9 == 6, "unknown").otherwise(F.col("event_ts"))
    copies = days.where(number % 3 == 0).withColumn("event_ts", again)
    copies.repartition(2).write.mode("append").options(**WRITE).parquet(src)
    sink, ck = new_paths(spark, "sink", "ckpt")
    stream = _stream(spark, sf, src)
    dedup_to_sink(stream, ["txn_id"], sink, ck, "event_ts")
    return read_deduplicated(spark, sink, stream.schema)


_PART = "CAST(substr(txn_id, 5) AS BIGINT) % 5"


def _running_sql():
    from tersus.suite import sql as S
    from tersus.suite.plan_queries import _g4_sql
    for i in range(5):
        S.VIEWS[f"r4_upto{i}"] = f"SELECT * FROM r4 WHERE {_PART} <= {i}"
        S._DEPS[f"r4_upto{i}"] = ["r4"]
    return with_views(" UNION ALL ".join(
        f"SELECT {i} AS batch_id, (SELECT count(*) FROM r4_upto{i}) AS n_rows, g.score FROM ({_g4_sql(f'r4_upto{i}', True)}) g"
        for i in range(5)), *[f"r4_upto{i}" for i in range(5)])


@query("st4_running_score", _running_sql())
def st4_running_score(spark, sf):
    """The score after each of five micro-batches of known rows."""
    history = ctx(spark, sf).stream_days
    fitted = fit_recipe(history.drop("arrival_day"), rc.R4_STREAM)
    src = stage_in_order(history, spark, F.expr(_PART), 5)
    sink, scores, ck = new_paths(spark, "sink", "scores", "ckpt")
    running_score(_stream(spark, sf, src).drop("arrival_day"), fitted, sink, scores, ck)
    return spark.read.parquet(scores)


_NULLS = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in STREAM_COLS)


@query("st5_running_profile", with_views(f"SELECT count(*) AS n_rows, {_NULLS} FROM stream_dirty", "stream_dirty"))
def st5_running_profile(spark, sf):
    sink, ck = new_paths(spark, "profile", "ckpt")
    running_profile(_stream(spark, sf), sink, ck, columns=STREAM_COLS)
    totals = spark.read.parquet(sink)
    # complete mode: the latest trigger holds the running totals (a top-1 report)
    return totals.orderBy(F.col("batch_seq").desc()).limit(1).drop("batch_seq", "batch_id")


def _share(expr):
    return f"avg(CAST({expr} AS DOUBLE))"


_DRIFT = {"amount_null_share": f"{k1('amount')} IS NULL", "event_ts_unparseable_share": f"{k2('event_ts')} IS NULL",
          "category_null_share": "category IS NULL", "region_null_share": "region IS NULL"}
# shares are counts / rows on both sides (Spark sums per-batch counts)
_DRIFT_SQL = with_views(
    "SELECT d.arrival_day, d.n_rows, " + ", ".join(
        f"round(d.{k}, 6) AS {k}, abs(d.{k} - b.{k}) > 0.05 AS {k.replace('_share', '_drift')}" for k in _DRIFT)
    + " FROM (SELECT arrival_day, count(*) AS n_rows, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE {v}) AS DOUBLE) / count(*) AS {k}" for k, v in _DRIFT.items())
    + " FROM stream_dirty_days GROUP BY arrival_day) d, (SELECT "
    + ", ".join(f"{_share(v)} AS {k}" for k, v in _DRIFT.items()) + " FROM stream_dirty) b",
    "stream_dirty_days")


@query("st6_drift_detection", _DRIFT_SQL)
def st6_drift_detection(spark, sf):
    baseline = fit_drift_baseline(ctx(spark, sf).stream)
    sink, ck = new_paths(spark, "drift", "ckpt")
    drift_to_sink(_stream(spark, sf), sink, ck)
    return drift_report(spark.read.parquet(sink), baseline)



def _g4_final_sql():
    from tersus.suite.plan_queries import _g4_sql
    return with_views(f"SELECT (SELECT count(*) FROM r4) AS n_rows, g.score FROM ({_g4_sql('r4', True)}) g", "r4")


@query("st4_running_score_final", _g4_final_sql())
def st4_running_score_final(spark, sf):
    """The running score after the last micro-batch (a top-1 report over the
    score sink): every batch has then been cleaned and accumulated, so it equals
    the batch scorecard of the cleaned table."""
    fitted = fit_recipe(ctx(spark, sf).stream, rc.R4_STREAM)
    sink, scores, ck = new_paths(spark, "sink", "scores", "ckpt")
    running_score(_stream(spark, sf).drop("arrival_day"), fitted, sink, scores, ck)
    return spark.read.parquet(scores).orderBy(F.col("batch_id").desc()).limit(1).select("n_rows", "score")


@query("st4_running_score_frozen_final", _g4_final_sql())
def st4_running_score_frozen_final(spark, sf):
    """The O(batch) running score (per-batch counts, IQR fences frozen from the
    cleaned history) after the last micro-batch. With the whole table as history
    the fences are those of the cleaned table, so it equals the batch scorecard."""
    from tersus.streaming import frozen_fences, running_score_frozen, running_score_table
    stream_hist = ctx(spark, sf).stream
    fitted = fit_recipe(stream_hist, rc.R4_STREAM)
    fences = frozen_fences(fitted.apply(stream_hist))
    sink, ck = new_paths(spark, "counts", "ckpt")
    running_score_frozen(_stream(spark, sf).drop("arrival_day"), fitted, fences, sink, ck)
    table = running_score_table(spark.read.parquet(sink))
    return table.orderBy(F.col("batch_id").desc()).limit(1).select("n_rows", "score")


@query("n6_stream_forward_fill", with_views(
    f"SELECT txn_id, customer_id, last_value({k3('category')} IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY CAST(substr(txn_id, 5) AS "
    "BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM stream_dirty", "stream_dirty"))
def n6_stream_forward_fill(spark, sf):
    """Five micro-batches, days in order; each customer's last category is state."""
    days = ctx(spark, sf).stream_days.withColumn("number", F.expr("CAST(substr(txn_id, 5) AS BIGINT)"))
    ids = days.agg(F.min("number"), F.max("number")).first()
    part = F.floor((F.col("number") - F.lit(ids[0])) * 5 / F.lit(ids[1] - ids[0] + 1))
    src = stage_in_order(days, spark, part, 5)
    sink, ck = new_paths(spark, "sink", "ckpt")
    forward_fill_to_sink(read_stream(spark, src, RAW_DAYS_SCHEMA + ", number BIGINT"), "category", "customer_id", "number", sink, ck)
    return _read_sink(spark, sink).select("txn_id", "customer_id", "category")


@query("p3_duplicate_estimate", with_views(
    "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS duplicates, "
    "true AS inside_bound FROM orders_dirty", "orders_dirty"))
def p3_duplicate_estimate(spark, sf):
    """The duplicates of an accumulated stream by one sketch a micro-batch, held against the exact count."""
    orders = ctx(spark, sf).orders
    src = stage_batches(orders, spark, "order_date")
    sink, ck = new_paths(spark, "sketches", "ckpt")
    dup.sketch_to_sink(read_stream(spark, src, ", ".join(f"{c} {t}" for c, t in orders.dtypes)), sink, ck)
    exact = duplicate_count(orders).first()["duplicate_count"]
    return dup.duplicate_estimate(dup.read_sketches(spark, sink)).select(
        F.col("rows").alias("n_rows"), F.lit(exact).cast("long").alias("duplicates"),
        (F.abs(F.col("duplicate_estimate") - F.lit(exact)) <= F.col("error")).alias("inside_bound"))
