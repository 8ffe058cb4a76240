import os
import tempfile

import pytest

from pyspark.sql import functions as F

from tersus.errors import CleaningError
from tersus.plans import recipes as rc
from tersus.streaming import clean_to_sink, fit_recipe, read_stream

SF = "/root/testdata/sf0.001"


def _rounded(df):
    """Rows with doubles rounded: distributed sums add partials in arrival order,
    so the last bit of a mean may differ between runs."""
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


def _dirty(spark):
    from tersus.sources import fixtures as fx
    from tersus.sources.readers import load_tables
    base = load_tables(spark, SF)
    return base, fx


def test_batched_fits_equal_sequential(spark):
    base, fx = _dirty(spark)
    o, c = fx.orders_dirty_base(base["orders"]), fx.customers_dirty(base["customer"], base["nation"])
    tables = {"orders": o, "customers": c}
    a = rc.apply_steps(tables, rc.R3_ETL, batch_fits=True)["merged"]
    b = rc.apply_steps(tables, rc.R3_ETL, batch_fits=False)["merged"]
    assert _rounded(a) == _rounded(b)
    s = fx.stream_dirty(base["events"])
    a = rc.apply_steps({"stream": s}, rc.R4_STREAM, default_table="stream")["stream"]
    b = rc.apply_steps({"stream": s}, rc.R4_STREAM, default_table="stream", batch_fits=False)["stream"]
    assert _rounded(a) == _rounded(b)


def test_recipes_raise_scores(spark):
    from tersus.plans import quality as ql
    base, fx = _dirty(spark)
    people = fx.people_dirty(base["customer"])
    before = ql.scorecard_null_fixing(people, rc.r7_golden_null_fix(people)).first()["score"]
    after = ql.scorecard_null_fixing(rc.r1_null_fix(people), rc.r7_golden_null_fix(people)).first()["score"]
    assert after > before and after == 0.98
    s = fx.stream_dirty(base["events"])
    assert ql.scorecard_stream(rc.r4_stream(s)).first()["score"] > ql.scorecard_stream(s).first()["score"]


def test_step_spec_errors_list_names(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(KeyError, match="it has|there are"):
        rc.apply_steps({"main": df}, [{"operation": "fill_nulls", "column": "zz", "table_name": "main"}])
    with pytest.raises(KeyError, match="it has|there are"):
        rc.apply_steps({"main": df}, [{"operation": "fill_nulls", "column": "a", "table_name": "nope"}])


def test_stream_result_equals_batch_result(spark):
    base, fx = _dirty(spark)
    days = fx.stream_dirty(base["events"], with_day=True)
    hist = fx.stream_dirty(base["events"])
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = os.path.join(root, "src")
    days.repartition("arrival_day").write.partitionBy("arrival_day").parquet(src)
    schema = ("txn_id STRING, customer_id BIGINT, amount STRING, category STRING, region STRING, "
              "event_ts STRING, arrival_day DATE")
    fitted = fit_recipe(hist, rc.R4_STREAM)
    sink = os.path.join(root, "sink")
    clean_to_sink(read_stream(spark, src, schema, max_files_per_trigger=4),
                  lambda df: fitted.apply(df.drop("arrival_day")), sink, os.path.join(root, "ck"))
    got = spark.read.parquet(sink).drop("batch_id")
    want = rc.r4_stream(hist)
    assert _rounded(got) == _rounded(want.select(*got.columns))


def test_stream_dedup_keeps_late_and_untimed_rows_once(spark):
    from tersus.streaming import dedup_to_sink, read_deduplicated
    from tersus.suite.staging import stage_in_order
    rows = [("a", "2024-01-20", 0), ("b", "2024-01-20", 0), ("a", "2024-01-20", 0), ("u", "never", 0),
            ("late", "2024-01-01", 1), ("a", "2024-01-20", 1), ("u", "never", 1), (None, "never", 1),
            ("late", "2024-01-01", 2), ("c", "2024-02-20", 2), (None, "never", 2), ("u", "never", 2)]
    df = spark.createDataFrame(rows, "k string, at string, part int")
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = stage_in_order(df, spark, F.col("part"), 3, os.path.join(root, "src"))
    stream = read_stream(spark, src, "k STRING, at STRING, part INT")
    dedup_to_sink(stream, ["k"], os.path.join(root, "sink"), os.path.join(root, "ck"), "at")
    got = read_deduplicated(spark, os.path.join(root, "sink"), stream.schema).collect()
    assert sorted((str(r["k"]), r["part"]) for r in got) == sorted([("a", 0), ("b", 0), ("u", 0), ("late", 1), ("None", 1), ("c", 2)])


def test_stream_dedup_compares_keys_whatever_the_event_day(spark):
    from tersus.streaming import dedup_to_sink, read_deduplicated
    from tersus.suite.staging import stage_in_order
    rows = [("a", "2024-01-20 23:59:00", 0), ("a", "2024-01-21 00:01:00", 0), ("b", "never", 0), ("b", "2024-01-20", 0),
            ("c", "2024-01-20", 0), ("a", "2024-01-22", 1), ("b", "2024-03-01", 1), ("c", "never", 1), (None, "2024-01-01", 1),
            ("d", "never", 1), ("d", "2024-01-02", 2), (None, "never", 2), ("c", "2023-01-01", 2)]
    df = spark.createDataFrame(rows, "k string, at string, part int")
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = stage_in_order(df, spark, F.col("part"), 3, os.path.join(root, "src"))
    stream = read_stream(spark, src, "k STRING, at STRING, part INT")
    dedup_to_sink(stream, ["k"], os.path.join(root, "sink"), os.path.join(root, "ck"), "at")
    got = read_deduplicated(spark, os.path.join(root, "sink"), stream.schema).collect()
    assert sorted((str(r["k"]), r["at"]) for r in got) == [
        ("None", "2024-01-01"), ("a", "2024-01-20 23:59:00"), ("b", "2024-01-20"), ("c", "2024-01-20"), ("d", "never")]


def _dedup_stream(spark, rows, parts, root):
    from tersus.suite.staging import stage_in_order
    schema = "k STRING, j INT, at STRING, v STRING, part INT"
    src = stage_in_order(spark.createDataFrame(rows, schema), spark, F.col("part"), parts, os.path.join(root, "src"))
    return read_stream(spark, src, schema)


def test_stream_dedup_does_not_age(spark):
    """Over 50 batches each looks up its own keys in the state, and reads nothing of what came before."""
    from tersus.streaming import dedup_to_sink, read_deduplicated
    rows = [(f"k{(i * 7) % 900}", 1, f"2024-01-{1 + i % 28:02d}", str(i), i // 30) for i in range(1500)]
    root = tempfile.mkdtemp(prefix="tersus-test-")
    stream = _dedup_stream(spark, rows, 50, root)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = dedup_to_sink(stream, ["k", "j"], os.path.join(root, "sink"), os.path.join(root, "ck"), "at")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert [p.numInputRows for p in progress] == [30] * 50
    gets = [p.stateOperators[0].customMetrics["rocksdbGetCount"] for p in progress]
    read = [p.stateOperators[0].customMetrics["rocksdbTotalBytesRead"] for p in progress]
    assert max(gets) <= 60 and max(read[40:]) <= 30 * 64
    assert progress[-1].stateOperators[0].numRowsTotal == 900
    got = read_deduplicated(spark, os.path.join(root, "sink"), stream.schema).collect()
    assert sorted(r["k"] for r in got) == sorted(f"k{i}" for i in range(900))


def test_stream_dedup_goes_on_after_a_restart_with_ties_and_a_hot_key(spark):
    from tersus.streaming import dedup_to_sink, read_deduplicated
    root = tempfile.mkdtemp(prefix="tersus-test-")
    hot = [("hot", 1, "2024-01-02", f"{i:04d}", 0) for i in range(600)]
    rows = hot + [("tie", 1, "2024-01-01", "b", 0), ("tie", 1, "2024-01-01", "a", 0), ("tie", 2, "2024-01-01", None, 0),
                  ("tie", 2, "2024-01-01", "z", 0), (None, None, "never", "n", 0)]
    sink, ck = os.path.join(root, "sink"), os.path.join(root, "ck")
    stream = _dedup_stream(spark, rows, 1, root)
    dedup_to_sink(stream, ["k", "j"], sink, ck, "at")
    more = [("hot", 1, "2023-01-01", "x", 1), ("new", 1, "never", "y", 1), (None, None, "2020-01-01", "x", 1), ("tie", 3, "never", "y", 1)]
    spark.createDataFrame(more, stream.schema).repartition(1).write.mode("append").parquet(os.path.join(root, "src"))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    dedup_to_sink(stream, ["k", "j"], sink, ck, "at")
    got = {(r["k"], r["j"]): r["v"] for r in read_deduplicated(spark, sink, stream.schema).collect()}
    assert got == {("hot", 1): "0000", ("tie", 1): "a", ("tie", 2): "z", (None, None): "n", ("new", 1): "y", ("tie", 3): "y"}


def test_stream_dedup_looks_keys_up_in_sparks_own_state(spark):
    """No call of Python for each key, and the earliest row among several Arrow batches of a task."""
    from tersus.streaming import dedup_to_sink, read_deduplicated
    rows = [(f"k{i % 40}", i % 2, f"2024-01-{28 - i // 40 % 28:02d}", None if i % 3 else str(i), i // 1200) for i in range(2400)]
    root = tempfile.mkdtemp(prefix="tersus-test-")
    stream = _dedup_stream(spark, rows, 2, root)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        query = dedup_to_sink(stream, ["k", "j"], os.path.join(root, "sink"), os.path.join(root, "ck"), "at")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [o.operatorName for o in query.recentProgress[-1].stateOperators] == ["dedupe"]
    want = {}
    for k, j, at, v, part in rows:
        if part == 0:
            want[k, j] = min(want.get((k, j), ("z",)), (at, f"v{v}" if v else "}"))
    got = {(r["k"], r["j"]): (r["at"], f"v{r['v']}" if r["v"] else "}") for r in read_deduplicated(spark, os.path.join(root, "sink"), stream.schema).collect()}
    assert got == want and len(got) == 40


def test_staged_files_are_read_by_several_tasks(spark):
    import pyarrow.parquet as pq
    from tersus.suite.staging import stage_batches
    path = stage_batches(spark.range(2_000_000).withColumn("b", F.lit(1)), spark, "b", 1)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in groups) == 2_000_000 and max(m.num_row_groups for m in groups) > 3


def test_each_micro_batch_of_one_file_is_shared_by_tasks(spark):
    from tersus.streaming.ingest import run_stream
    from tersus.suite.staging import stage_in_order
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = stage_in_order(spark.range(1_600_000), spark, F.col("id") % 2, 2, os.path.join(root, "src"))
    tasks = {}

    def handle(batch, batch_id):
        tasks[batch_id] = sorted(r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect())
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        run_stream(read_stream(spark, src, "id LONG").writeStream.foreachBatch(handle), os.path.join(root, "ck"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert {b: sum(n) for b, n in tasks.items()} == {0: 800_000, 1: 800_000} and min(map(len, tasks.values())) > 1


def test_refit_policy_is_deterministic(spark):
    from tersus.streaming import clean_with_refit
    base, fx = _dirty(spark)
    days = fx.stream_dirty(base["events"], with_day=True)
    hist = fx.stream_dirty(base["events"]).limit(0).unionByName(
        days.where(F.dayofmonth("arrival_day") <= 3).drop("arrival_day"))
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = os.path.join(root, "src")
    days.where(F.dayofmonth("arrival_day") > 3).repartition("arrival_day") \
        .write.partitionBy("arrival_day").parquet(src)
    schema = ("txn_id STRING, customer_id BIGINT, amount STRING, category STRING, region STRING, "
              "event_ts STRING, arrival_day DATE")
    sink, raw = os.path.join(root, "sink"), os.path.join(root, "raw")
    stream = read_stream(spark, src, schema, max_files_per_trigger=9).drop("arrival_day")
    clean_with_refit(stream, rc.R4_STREAM, hist, sink, raw, os.path.join(root, "ck"), refit_every=2)
    got = spark.read.parquet(sink)
    raws = spark.read.parquet(raw)
    ids = sorted(r[0] for r in raws.select("batch_id").distinct().collect())
    assert len(ids) >= 3
    for b in ids:
        cut = (b // 2) * 2
        seen = hist.unionByName(raws.where(F.col("batch_id") < cut).drop("batch_id").select(*hist.columns))
        want = fit_recipe(seen, rc.R4_STREAM).apply(raws.where(F.col("batch_id") == b).drop("batch_id"))
        assert _rounded(got.where(F.col("batch_id") == b).drop("batch_id")) == _rounded(want)


def test_replaced_file_gives_new_values_and_nothing_stays_cached(spark, tmp_path):
    path = str(tmp_path / "orders")
    def write(amount):
        spark.createDataFrame([(1, 2, str(amount), "2024-01-01", "x", "O"), (2, 2, None, "2024-01-01", "x", "O")],
                              "order_id long, customer_id long, amount string, order_date string, priority string, status string"
                              ).write.mode("overwrite").parquet(path)
    for amount in (10.0, 99.0):
        write(amount)
        assert {r["amount"] for r in rc.r2_normalise(spark.read.parquet(path)).collect()} == {amount}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_batched_fits_equal_single_fits(spark):
    df = spark.createDataFrame([(str(i), None if i % 4 == 0 else str(i * 1.7), "x " if i % 3 else None) for i in range(40)],
                               "a string, b string, c string")
    steps = [{"operation": "normalize_values", "column": "c", "method": "strip"},
             {"operation": "add_derived_column", "column_name": "d", "source_column": "b", "transform": "abs"},
             {"operation": "fill_nulls", "column": "b", "strategy": "mean", "round_to": 2},
             {"operation": "fill_nulls", "column": "d", "strategy": "mean", "integral": True},
             {"operation": "fill_nulls", "column": "c", "strategy": "mode"},
             {"operation": "fill_nulls", "column": "a", "strategy": "median"},
             {"operation": "cast_column", "column": "a", "dtype": "int"},
             {"operation": "filter_outliers", "column": "b", "method": "iqr", "threshold": 0.5}]
    for k in range(1, len(steps) + 1):
        a = rc.apply_steps({"main": df}, steps[:k])["main"]
        b = rc.apply_steps({"main": df}, steps[:k], batch_fits=False)["main"]
        assert a.dtypes == b.dtypes and _rounded(a) == _rounded(b), k


def test_int_cast_after_a_rewrite_checks_again(spark):
    df = spark.createDataFrame([("1", "N/A"), (None, "3")], "a string, b string")
    fill = {"operation": "fill_nulls", "column": "a", "strategy": "mean"}
    cast = {"operation": "cast_column", "column": "a", "dtype": "int"}
    assert rc.apply_steps({"main": df}, [fill, cast])["main"].schema["a"].dataType.typeName() == "long"
    rewrite = {"operation": "add_derived_column", "column_name": "a", "source_column": "b", "transform": "abs"}
    with pytest.raises(CleaningError, match="1 value"):
        rc.apply_steps({"main": df}, [fill, rewrite, cast])


def test_processing_time_trigger_returns_running_query(spark):
    from tersus.streaming import run_stream
    base, fx = _dirty(spark)
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = os.path.join(root, "src")
    fx.stream_dirty(base["events"]).write.parquet(src)
    schema = "txn_id STRING, customer_id BIGINT, amount STRING, category STRING, region STRING, event_ts STRING"
    sink = os.path.join(root, "sink")
    q = run_stream(read_stream(spark, src, schema).writeStream.format("parquet").option("path", sink),
                   os.path.join(root, "ck"), trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        assert spark.read.parquet(sink).count() == fx.stream_dirty(base["events"]).count()
    finally:
        q.stop()


def test_frozen_fence_running_score_matches_batch_counts(spark):
    from tersus.plans.quality import G4_W
    from tersus.streaming import frozen_fences, running_score_frozen, running_score_table
    from tersus.suite.staging import stage_batches
    from tersus.streaming.monitor import score_counts
    base, fx = _dirty(spark)
    days = fx.stream_dirty(base["events"], with_day=True)
    hist = fx.stream_dirty(base["events"])
    fitted = fit_recipe(hist, rc.R4_STREAM)
    fences = frozen_fences(fitted.apply(hist))
    root = tempfile.mkdtemp(prefix="tersus-test-")
    src = stage_batches(days, spark, "arrival_day", files=6, path=os.path.join(root, "src"))
    schema = ("txn_id STRING, customer_id BIGINT, amount STRING, category STRING, region STRING, "
              "event_ts STRING, arrival_day DATE")
    sink = os.path.join(root, "counts")
    running_score_frozen(read_stream(spark, src, schema, max_files_per_trigger=1).drop("arrival_day"),
                         fitted, fences, sink, os.path.join(root, "ck"))
    table = running_score_table(spark.read.parquet(sink)).orderBy("batch_id").collect()
    assert len(table) >= 3 and table[-1]["n_rows"] == fitted.apply(hist).count()
    # the last cumulative row equals the same formula over the whole cleaned table at once
    whole = score_counts(fitted.apply(hist), fences).first()
    n = whole["n"]
    frac = whole["outside"] / whole["amount_values"]
    tier = G4_W["outliers"][0] if frac < G4_W["outlier_cuts"][0] else (
        G4_W["outliers"][1] if frac < G4_W["outlier_cuts"][1] else 0.0)
    want = (0.25 * max(0, 1 - 3 * whole["amount_nulls"] / n) + 0.20 + tier
            + 0.15 * max(0, 1 - 3 * whole["category_nulls"] / n) + 0.10 * max(0, 1 - 3 * whole["region_nulls"] / n)
            + 0.10)
    assert table[-1]["score"] == pytest.approx(max(0.05, min(0.98, want)), abs=1e-6)


def test_r2_and_r3_raise_their_scorecards(spark):
    from tersus.plans import quality as ql
    base, fx = _dirty(spark)
    orders, base_orders = fx.orders_dirty(base["orders"]), fx.orders_dirty_base(base["orders"])
    before = ql.scorecard_normalisation(orders, base_orders, country="priority").first()["score"]
    after = ql.scorecard_normalisation(rc.r2_normalise(orders), base_orders, country="priority").first()["score"]
    assert after > before
    customers = fx.customers_dirty(base["customer"], base["nation"])
    golden = rc.r5_golden_etl(base_orders, customers)
    assert ql.scorecard_etl({"orders": base_orders}, golden).first()["score"] == 0.05  # nothing merged yet
    assert ql.scorecard_etl({"merged": rc.r3_etl(base_orders, customers)}, golden).first()["score"] > 0.05


def test_value_counts_are_merged_by_levels(spark):
    """41 batches write n log n counts and keep a run for each bit; a retried batch gives the same counts."""
    from tersus.streaming.monitor import ValueCounts, live_runs
    assert live_runs(0) == [] and live_runs(6) == [(0, 4), (4, 6)] and live_runs(8) == [(0, 8)]
    counts = ValueCounts(spark, os.path.join(tempfile.mkdtemp(prefix="tersus-test-"), "values"))
    written, size, n = 0, 10, 41
    for b in range(n):
        values = spark.createDataFrame([(float(b * size + i), 1) for i in range(size)] + [(-1.0, 2)], "v double, n long").coalesce(1)
        for _ in range(2 if b % 7 == 3 else 1):  # some are retried
            counts.add(b, values)
        start, end = live_runs(b + 1)[-1]
        written += (end - start) * size + 1
        folders = [f for f in os.listdir(counts.root) if f.startswith("run-")]
        assert len(folders) <= 2 * n.bit_length()
        if b in (0, 6, 7, 40):
            got = {r["v"]: r["n"] for r in counts.read(b + 1).groupBy("v").agg(F.sum("n").alias("n")).collect()}
            assert got == {**{float(i): 1 for i in range((b + 1) * size)}, -1.0: 2 * (b + 1)}
    assert written <= n * (size + 1) * n.bit_length()
