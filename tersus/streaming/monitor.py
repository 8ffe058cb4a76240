"""ST4-ST6: running quality score, running profile and drift detection.

* ST5 running profile: additive counts kept by a streaming aggregation
  (``complete`` mode, one state row), so state does not grow with the stream.
* ST4 running score: each micro-batch is cleaned, appended to the sink and counted.
  The score of everything accumulated comes from sums of those counts and, for the
  outlier fences, from value -> count tables of the amounts, merged level by level so
  that n batches write n log n of them; accumulated rows are not read again.
* ST6 drift: per-batch counts of null / unparseable values per arrival day
  (additive, so a day may span batches) against a baseline fitted on history;
  flags columns whose share moved by more than a tolerance.

All sinks are written under the checkpoint folder, one sub-folder per batch id
with overwrite, so a retried micro-batch replaces its own output (idempotent).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersus.functions.parse import DATE_FORMATS, col, is_numeric, is_temporal, to_double, to_timestamp
from tersus.functions.stats import FitBatch, exact_quantiles
from tersus.plans.quality import G4_W, SCORE_FLOOR, clamp, completeness_prop, iqr_bounds, outlier_tier
from tersus.session import scratch_dir
from tersus.streaming.ingest import run_stream


def _write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(os.path.join(root, f"batch_id={batch_id}"))


def drift_counts(df: DataFrame, amount: str = "amount", ts: str = "event_ts", nullable=("category", "region"),
                 formats=DATE_FORMATS) -> dict:
    """Additive counts ST6 watches: {metric: (numerator expression)}; shares are
    numerator / row count, so per-batch counts can be summed across batches."""
    num = to_double(amount, df.schema[amount].dataType)
    out = {f"{amount}_null": num.isNull(),
           f"{ts}_unparseable": to_timestamp(ts, df.schema[ts].dataType, formats).isNull()}
    for c in nullable:
        out[f"{c}_null"] = col(c).isNull()
    return out


def fit_drift_baseline(history: DataFrame, **kw) -> dict:
    """Baseline shares of the watched counts over a history table (one aggregation)."""
    m = drift_counts(history, **kw)
    row = history.agg(*[F.avg(v.cast("double")).alias(k) for k, v in m.items()]).first()
    return {k: row[k] for k in m}


def drift_batch_counts(batch: DataFrame, by: str = "arrival_day", **kw) -> DataFrame:
    """Per micro-batch: row and offending-value counts per ``by`` value."""
    m = drift_counts(batch, **kw)
    return batch.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[F.count_if(v).alias(f"n_{k}") for k, v in m.items()])


def drift_report(counts: DataFrame, baseline: dict, by: str = "arrival_day", tolerance: float = 0.05) -> DataFrame:
    """Sum per-batch counts per ``by`` value (a value may span batches), turn them
    into shares and flag |share - baseline| > tolerance."""
    keys = list(baseline)
    tot = counts.groupBy(by).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in keys])
    cols = [by, "n_rows"]
    for k in keys:
        share = F.col(f"n_{k}") / F.col("n_rows")
        cols.append(F.round(share, 6).alias(f"{k}_share"))
        cols.append((F.abs(share - F.lit(baseline[k])) > F.lit(tolerance)).alias(f"{k}_drift"))
    return tot.select(*cols)


def running_profile(stream: DataFrame, sink: str, checkpoint: str, columns=None, trigger: dict | None = None) -> str:
    """ST5: streaming aggregation of row and null counts; each trigger's totals
    are written under the batch id. Returns the sink folder."""
    columns = columns or [c for c in stream.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")] + \
        [F.count_if(col(c).isNull()).alias(f"{c}_nulls") for c in columns]
    totals = stream.agg(*aggs)
    writer = totals.writeStream.outputMode("complete").foreachBatch(
        lambda df, bid: _write_batch(df.withColumn("batch_seq", F.lit(bid)), sink, bid))
    run_stream(writer, checkpoint, trigger)
    return sink


def live_runs(batches: int) -> list[tuple[int, int]]:
    """The runs [from, to) of batches whose value counts are kept after so many batches: one for each bit that is set,
    the longest first."""
    runs, start = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            runs.append((start, start + (1 << bit)))
            start += 1 << bit
    return runs


class ValueCounts:
    """How often each value came so far, as runs of batches, each a table (v, n). Batch ``b`` writes one run: its own
    counts merged with the runs that end a power of two with it. Each count is thus rewritten once for each doubling of
    the stream, and at most one run for each bit of the batch number is live. What a retried batch merges is still
    there: runs go only when the next batch begins."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def _path(self, run: tuple[int, int]) -> str:
        return os.path.join(self.root, f"run-{run[0]:010d}-{run[1]:010d}")

    def read(self, batches: int) -> DataFrame:
        """(v, n) of the first ``batches`` batches; a value has a row in each run that it is in."""
        return self.spark.read.schema("v double, n long").parquet(*map(self._path, live_runs(batches)))

    def add(self, batch_id: int, values: DataFrame) -> None:
        """``values``: the batch's own (v, n)."""
        before, after = live_runs(batch_id), live_runs(batch_id + 1)
        self._keep_only(before)
        merged = [self._path(r) for r in before if r not in after]
        if merged:
            values = values.unionByName(self.spark.read.schema("v double, n long").parquet(*merged))
        values.groupBy("v").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(self._path(after[-1]))

    def _keep_only(self, runs) -> None:
        keep = {os.path.basename(self._path(r)) for r in runs}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root) if files.exists(root) else []:
            if status.getPath().getName() not in keep:
                files.delete(status.getPath(), True)


def running_score(stream: DataFrame, fitted_recipe, sink: str, scores: str, checkpoint: str,
                  score_every: int = 1, amount: str = "amount", trigger: dict | None = None) -> str:
    """ST4: clean each micro-batch with a fitted recipe, append it to ``sink``, and after every
    ``score_every`` batches write the exact score of all batches so far to ``scores``.

    Beside the scores lie the per-batch counts and the amounts' ``ValueCounts``."""
    spark = stream.sparkSession
    counts_path, values = scores + "-counts", ValueCounts(stream.sparkSession, scores + "-values")

    def handle(batch: DataFrame, batch_id: int):
        clean = fitted_recipe.apply(batch)
        _write_batch(clean, sink, batch_id)
        clean = spark.read.schema(clean.schema).parquet(os.path.join(sink, f"batch_id={batch_id}"))
        _write_batch(score_counts(clean, None, amount), counts_path, batch_id)
        num = to_double(amount, clean.schema[amount].dataType)
        values.add(batch_id, clean.select(num.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n")))
        if batch_id % score_every:
            return
        seen = values.read(batch_id + 1)
        bounds = iqr_bounds(exact_quantiles(seen, [(F.col("v"), [0.25, 0.75])], weight=F.col("n"), stored=True)[0])
        outside = 0
        if bounds:
            far = (F.col("v") < F.lit(bounds[0])) | (F.col("v") > F.lit(bounds[1]))
            outside = seen.agg(F.sum(F.when(far, F.col("n")).otherwise(0))).first()[0] or 0
        counts = spark.read.parquet(counts_path).where(F.col("batch_id") <= batch_id)
        total = counts.agg(*[F.sum(c).alias(c) for c in SCORE_COUNTS]).withColumn("outside", F.lit(outside))
        numeric, typed = is_numeric(clean.schema[amount].dataType), is_temporal(clean.schema["event_ts"].dataType)
        _write_batch(total.select(F.col("n").alias("n_rows"), stream_score(numeric, typed).alias("score")), scores, batch_id)

    run_stream(stream.writeStream.foreachBatch(handle), checkpoint, trigger)
    return scores


def frozen_fences(history_clean: DataFrame, amount: str = "amount", t: float = 1.5):
    """IQR fences of the cleaned history, fitted once (exact quantiles)."""
    b = FitBatch(history_clean)
    b.quantile("q", to_double(amount, history_clean.schema[amount].dataType), [0.25, 0.75])
    q1, q3 = b.run()["q"]
    if q1 is None:
        return None
    return q1 - t * (q3 - q1), q3 + t * (q3 - q1)


def score_counts(df: DataFrame, fences, amount: str = "amount", category: str = "category",
                 region: str = "region", ts: str = "event_ts") -> DataFrame:
    """Additive counts behind the stream scorecard for one batch (one row)."""
    num = to_double(amount, df.schema[amount].dataType)
    outside = F.lit(False) if fences is None else (num < F.lit(fences[0])) | (num > F.lit(fences[1]))
    parsed = to_timestamp(ts, df.schema[ts].dataType)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(num.isNull()).alias("amount_nulls"),
                  F.count(num).alias("amount_values"), F.count_if(num.isNotNull() & outside).alias("outside"),
                  F.count_if(F.col(category).isNull()).alias("category_nulls"),
                  F.count_if(F.col(region).isNull()).alias("region_nulls"),
                  F.count(parsed).alias("ts_parsed"))


def running_score_frozen(stream: DataFrame, fitted_recipe, fences, sink: str, checkpoint: str,
                         trigger: dict | None = None) -> str:
    """ST4 in O(batch): each cleaned micro-batch contributes additive counts; the
    outlier share is measured against IQR fences frozen at fit time instead of
    fences re-derived from everything accumulated (the exact ``running_score``)."""
    run_stream(stream.writeStream.foreachBatch(
        lambda df, bid: _write_batch(score_counts(fitted_recipe.apply(df), fences), sink, bid)), checkpoint, trigger)
    return sink


SCORE_COUNTS = ("n", "amount_nulls", "amount_values", "outside", "category_nulls", "region_nulls", "ts_parsed")


def stream_score(amount_numeric: bool, ts_typed: bool):
    """The stream scorecard as an expression of its summed counts (``SCORE_COUNTS``)."""
    n = F.col("n").cast("double")
    amount_type = F.lit(G4_W["amount_type"]) if amount_numeric else \
        F.when(F.col("amount_nulls") / n < G4_W["amount_parse_max_nulls"], F.lit(G4_W["amount_parse"])) \
        .otherwise(F.lit(0.0))
    frac = F.when(F.col("amount_values") > 0, F.col("outside") / F.col("amount_values"))
    parts = [completeness_prop(F.col("amount_nulls") / n, G4_W["amount_nulls"]), amount_type,
             outlier_tier(frac, G4_W["outlier_cuts"], G4_W["outliers"]),
             completeness_prop(F.col("category_nulls") / n, G4_W["category_nulls"]),
             completeness_prop(F.col("region_nulls") / n, G4_W["region_nulls"]),
             F.lit(G4_W["ts_type"]) if ts_typed else F.lit(G4_W["ts_type"]) * F.col("ts_parsed") / n]
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    return F.when(F.col("n") == 0, F.lit(SCORE_FLOOR)).otherwise(F.round(clamp(total), 6))


def running_score_table(counts: DataFrame, amount_numeric: bool = True, ts_typed: bool = True) -> DataFrame:
    """Cumulative stream scorecard per batch from per-batch counts. The window
    runs over one row per batch, not over data rows."""
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.select("batch_id", *[F.sum(x).over(w).alias(x) for x in SCORE_COUNTS])
    return c.select("batch_id", F.col("n").alias("n_rows"), stream_score(amount_numeric, ts_typed).alias("score"))


def clean_to_sink(stream: DataFrame, transform, sink: str, checkpoint: str, trigger: dict | None = None) -> str:
    """ST2: apply a fitted recipe per micro-batch and append the result."""
    run_stream(stream.writeStream.foreachBatch(lambda df, bid: _write_batch(transform(df), sink, bid)), checkpoint, trigger)
    return sink


def clean_with_refit(stream: DataFrame, steps, history: DataFrame, sink: str, raw_sink: str, checkpoint: str,
                     refit_every: int, trigger: dict | None = None) -> str:
    """ST2 with an explicit re-fit policy (H8).

    Micro-batch ``b`` is cleaned with statistics fitted on ``history`` plus every
    raw batch before ``cut = (b // refit_every) * refit_every``. The raw batches
    are kept under ``raw_sink`` (one folder per batch id), so after a restart the
    same statistics are re-derived: the result does not depend on which process
    ran which batch, only on ``refit_every``.
    """
    from tersus.streaming.clean import fit_recipe

    spark = stream.sparkSession
    state = {"cut": None, "fitted": None}

    def handle(batch: DataFrame, batch_id: int):
        _write_batch(batch, raw_sink, batch_id)
        cut = (batch_id // refit_every) * refit_every if refit_every else 0
        if state["cut"] != cut:
            seen = history
            if cut > 0:
                raw = spark.read.parquet(raw_sink).where(F.col("batch_id") < cut).drop("batch_id")
                seen = history.unionByName(raw.select(*history.columns))
            state["fitted"], state["cut"] = fit_recipe(seen, steps), cut
        _write_batch(state["fitted"].apply(batch), sink, batch_id)

    run_stream(stream.writeStream.foreachBatch(handle), checkpoint, trigger)
    return sink


def drift_to_sink(stream: DataFrame, sink: str, checkpoint: str, by: str = "arrival_day", trigger: dict | None = None,
                  **kw) -> str:
    """ST6: per-batch drift counts appended to ``sink``; read them with
    ``drift_report(spark.read.parquet(sink), baseline)``."""
    run_stream(stream.writeStream.foreachBatch(
        lambda df, bid: _write_batch(drift_batch_counts(df, by, **kw), sink, bid)), checkpoint, trigger)
    return sink


def new_paths(spark, *names):
    root = scratch_dir(spark, "stream")
    return [os.path.join(root, n) for n in names]
