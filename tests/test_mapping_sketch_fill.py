import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tersus.errors import CleaningError
from tersus.operators import map_values, unmapped_values
from tersus.plans import duplicates as dup
from tersus.plans import recipes as rc
from tersus.plans.profile import duplicate_count
from tersus.streaming import fit_recipe, forward_fill_to_sink, read_stream
from tersus.suite.staging import stage_in_order

SYNONYMS = {"USA": "USA", "U.S.A": "USA", "United States": "USA", "us": "USA", "UK": "UK", "U.K.": "UK"}


# ------------------------------------------------------------------ mapping
def countries(spark):
    texts = ["usa", " U.S.A ", "United States", "US", "uk", "U.K.", "Mars", None, "", "mars"] + ["us"] * 40
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, `a.country` string").repartition(3)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_mapping_replaces_synonyms_and_keeps_the_rest(spark, bound):
    df = countries(spark)
    got = map_values(df, "a.country", SYNONYMS, broadcast_bytes=bound)
    assert got.columns == df.columns
    assert [r[1] for r in got.orderBy("id").collect()] == ["USA"] * 4 + ["UK"] * 2 + ["Mars", None, "", "mars"] + ["USA"] * 40
    left = unmapped_values(df, "a.country", SYNONYMS, broadcast_bytes=bound)
    assert {r["value"]: r["n"] for r in left.collect()} == {"Mars": 1, "": 1, "mars": 1}
    exact = map_values(df, "a.country", SYNONYMS, fold=False, broadcast_bytes=bound)
    assert [r[1] for r in exact.orderBy("id").collect()][:6] == ["usa", " U.S.A ", "USA", "US", "uk", "UK"]


def test_large_mappings_are_not_broadcast_by_force(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = map_values(countries(spark), "a.country", SYNONYMS)._jdf.queryExecution().executedPlan().toString()
        large = map_values(countries(spark), "a.country", SYNONYMS, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in small and "SortMergeJoin" in large


def test_mapping_refuses_what_is_not_one_result_a_value(spark):
    df = countries(spark)
    with pytest.raises(CleaningError, match="more than one result for 'us'"):
        map_values(df, "a.country", {"US": "USA", " us": "United States"})
    assert map_values(df, "a.country", {"US": "a", "us": "b"}, fold=False).count() == 50
    with pytest.raises(CleaningError, match="1 rows with NULL"):
        map_values(df, "a.country", {"US": None, "uk": "UK"})
    with pytest.raises(CleaningError, match="no text"):
        map_values(df, "id", SYNONYMS)
    empty = spark.createDataFrame([], "value string, canonical string")
    assert map_values(df, "a.country", empty).orderBy("id").collect() == df.orderBy("id").collect()
    assert map_values(df.limit(0), "a.country", SYNONYMS).count() == 0


def test_mapping_in_step_lists_and_streams(spark):
    df = countries(spark).withColumnRenamed("a.country", "country")
    table = spark.createDataFrame([(k, v) for k, v in SYNONYMS.items()], "seen string, name string")
    step = {"operation": "map_values", "column": "country", "mapping": "names", "value": "seen", "canonical": "name", "table_name": "main"}
    got = rc.apply_steps({"main": df, "names": table}, [step])["main"]
    assert got.where("country = 'USA'").count() == 44
    fitted = fit_recipe(df, [{"operation": "map_values", "column": "country", "mapping": SYNONYMS}])
    assert fitted.apply(df).where("country = 'USA'").count() == 44


# ------------------------------------------------------------------ duplicate sketch
def test_sketch_estimates_are_inside_their_bound_and_merge(spark):
    df = spark.range(0, 60_000, 1, 6).select((F.col("id") % 50_000).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id") % 50_000 % 7).alias("b"))
    exact = duplicate_count(df).first()["duplicate_count"]
    parts = dup.row_sketch(df.where("a < 20000")).unionByName(dup.row_sketch(df.where("a >= 20000"))).unionByName(dup.row_sketch(df.limit(0)))
    for sketches in (dup.row_sketch(df), parts):
        r = dup.duplicate_estimate(sketches).first()
        assert r["rows"] == 60_000 and abs(r["duplicate_estimate"] - exact) <= r["error"] <= 0.03 * 60_000
    r = dup.duplicate_estimate(dup.row_sketch(df, ["b"])).first()
    assert r["distinct_estimate"] == 8 and r["duplicate_estimate"] == 60_000 - 8


def test_sketch_tells_null_places_apart_and_takes_empty_tables(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", None), (None, None)], "a string, b string")
    r = dup.duplicate_estimate(dup.row_sketch(df)).first()
    assert (r["distinct_estimate"], r["duplicate_estimate"]) == (3, 1)
    for sketches in (dup.row_sketch(df.limit(0)), spark.createDataFrame([], dup.SCHEMA)):
        assert tuple(dup.duplicate_estimate(sketches).first()) == (0, 0, 0, 0)


def test_sketch_error_over_many_samples(spark):
    """The distinct rows of sets of other sizes and values: the bound of three standard errors holds nearly always."""
    sizes = [500 * (i + 1) for i in range(24)]
    rows = spark.range(max(sizes)).select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("s"), "id").where(F.col("id") < 500 * (F.col("s") + 1))
    per = rows.groupBy("s").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.xxhash64("s", "id"), F.lit(dup.LOG_REGISTERS)).alias("k"))
    off = [abs(r["e"] - r["n"]) / r["n"] for r in per.select("n", F.hll_sketch_estimate("k").alias("e")).collect()]
    assert sum(o > dup.error_bound() for o in off) <= 1 and sum(off) / len(off) < dup.error_bound() / 2


# ------------------------------------------------------------------ fill on a stream
FILL_SCHEMA = "k STRING, at INT, v STRING, part INT"


def run_fill(spark, rows, parts, root):
    src = stage_in_order(spark.createDataFrame(rows, FILL_SCHEMA), spark, F.col("part"), parts, os.path.join(root, "src"))
    stream = read_stream(spark, src, FILL_SCHEMA)
    forward_fill_to_sink(stream, "v", "k", "at", os.path.join(root, "sink"), os.path.join(root, "ck"))
    return {(r["k"], r["at"]): r["v"] for r in spark.read.schema(FILL_SCHEMA).option("recursiveFileLookup", "true")
            .parquet(os.path.join(root, "sink")).collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_fill_is_the_batch_fill_whatever_the_batches(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, None, "N/A", f"v{i}"]), i * parts // 200) for i in range(200)]
    rng.shuffle(rows)  # rows of a micro-batch come in any order
    want, last = {}, {}
    for k, at, v, _ in sorted(rows, key=lambda r: r[1]):
        if v not in (None, "N/A"):
            last[k] = v
        want[k, at] = last.get(k)
    assert run_fill(spark, rows, parts, tempfile.mkdtemp(prefix="tersus-test-")) == want


def test_stream_fill_of_late_rows_ties_and_a_restart(spark):
    root = tempfile.mkdtemp(prefix="tersus-test-")
    rows = [("a", 10, "ten", 0), ("a", 12, None, 0), ("t", 1, "p", 0), ("b", None, "early", 0), ("b", 1, None, 0)]
    got = run_fill(spark, rows, 1, root)
    assert got == {("a", 10): "ten", ("a", 12): "ten", ("t", 1): "p", ("b", None): "early", ("b", 1): "early"}
    # the second run goes on from the first one's state: late rows of a, an equal place of t
    late = [("a", 5, None, 0), ("a", 6, "six", 0), ("a", 7, None, 0), ("a", 13, None, 0), ("t", 2, None, 0), ("t", 3, "z", 0), ("t", 4, None, 0)]
    spark.createDataFrame(late, FILL_SCHEMA).repartition(1).write.mode("append").parquet(os.path.join(root, "src"))
    stream = read_stream(spark, os.path.join(root, "src"), FILL_SCHEMA)
    forward_fill_to_sink(stream, "v", "k", "at", os.path.join(root, "sink"), os.path.join(root, "ck"))
    out = spark.read.schema(FILL_SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(root, "sink")).collect()
    got = {(r["k"], r["at"]): r["v"] for r in out}
    assert len(out) == 12 and Counter(r["k"] for r in out)["a"] == 6
    assert [got["a", i] for i in (5, 6, 7, 13)] == [None, "six", "six", "ten"]
    assert [got["t", i] for i in (2, 3, 4)] == ["p", "z", "z"]


def test_stream_fill_refuses_bad_columns(spark):
    df = spark.createDataFrame([], FILL_SCHEMA)
    for bad in (("v", [], "at"), ("v", "k", []), ("at", "k", "at")):
        with pytest.raises(CleaningError):
            forward_fill_to_sink(df, *bad, "x", "y")
    with pytest.raises(KeyError):
        forward_fill_to_sink(df, "none", "k", "at", "x", "y")
