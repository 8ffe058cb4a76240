import json

import pytest

from tersus.errors import CleaningError
from tersus.plans.recipes import apply_steps, load_steps
from tersus.session import CLUSTER_CONF, scratch_dir
from tersus.sources import TableSet
from tersus.sources.readers import load_tables, read_table

SF_SMALL = "/root/testdata/sf0.001"


def test_table_lookup_lists_available_names(spark):
    t = TableSet({"a": spark.range(1)})
    with pytest.raises(KeyError, match=r"\['a'\]"):
        t["b"]
    assert "b" in t.bind("b", spark.range(2)) and "b" not in t


def test_lazy_tables_open_on_first_use(spark):
    base = load_tables(spark, SF_SMALL)
    assert "orders" in base and len(base) >= 8
    assert base._t == {}
    base["region"]
    assert list(base._t) == ["region"]


def test_scans_are_read_without_a_shuffle(spark):
    plan = read_table(spark, SF_SMALL, "lineitem")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_load_steps_from_json_and_validation(spark, tmp_path):
    steps = [{"operation": "drop_nulls", "column": "a"}]
    path = tmp_path / "recipe.json"
    path.write_text(json.dumps(steps))
    assert load_steps(str(path)) == steps and load_steps(json.dumps(steps)) == steps
    with pytest.raises(CleaningError):
        load_steps('[{"column": "a"}]')
    df = spark.createDataFrame([(1,), (None,)], "a long")
    assert apply_steps({"main": df}, load_steps(str(path)))["main"].count() == 1


def test_unknown_operation_rejected(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(CleaningError, match="teleport"):
        apply_steps({"main": df}, [{"operation": "teleport", "table_name": "main"}])


def test_cluster_preset_and_scratch_folder(spark):
    assert CLUSTER_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "256m"
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.split("/x/")[0] == b.split("/x/")[0]
