"""What the plans must look like: filters at the scan, few columns read, no product of tables, no Python in the hot path."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import LOG, op
from kvstrata.operators import compact, read
from kvstrata.operators.changes import live_keys
from kvstrata.sources.kv import KV_SCHEMA
from kvstrata.sources.scratch import _local_folder, durable, scratch_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def kv(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("kv") / "kv")
    spark.createDataFrame([(i % 3, f"k{i % 50:03}", i, "PUT" if i % 5 else "DEL", "v") for i in range(2000)], KV_SCHEMA).write.parquet(at)
    return spark.read.parquet(at)


def test_bounds_reach_the_scan(kv):
    p = plan(read.point_get(kv, 1, "k007", 700))
    for pushed in ("EqualTo(cf,1)", "EqualTo(key,k007)", "LessThanOrEqual(seq,700)"):
        assert pushed in p
    p = plan(read.scan(kv, bounds=read.key_range("k003", "k010")))
    assert "GreaterThanOrEqual(key,k003)" in p and "LessThan(key,k010)" in p
    assert "StringStartsWith(key,k0)" in plan(read.scan(kv, bounds=F.col("key").startswith("k0")))


def test_ranks_are_limited_before_the_shuffle(kv):
    p = plan(read.visible(kv))
    assert p.count("WindowGroupLimit") == 2 and p.count("Exchange") == 1 and "Python" not in p
    assert plan(compact.compact(kv, [100], True)).count("Exchange") == 2


def test_a_page_moves_keys_not_values(kv):
    p = plan(read.page(kv, 1, 5))
    assert "TakeOrderedAndProject" in p
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert any("value" not in s for s in schemas) and len(schemas) == 2


def test_state_of_a_feed_is_stored_not_recomputed(spark):
    out = live_keys(spark.createDataFrame([op(1, 0, "a", i, 1) for i in range(50)], LOG))
    p = plan(out)
    assert "Exchange" not in p and "FileScan parquet" in p


def test_scratch_tables_lie_in_the_application_folder(spark):
    at = scratch_dir(spark)
    assert spark.sparkContext.applicationId in at
    df = durable(spark.range(10))
    assert df.count() == 10 and df.inputFiles() and all(at.replace("file://", "") in f for f in df.inputFiles())


def test_no_machine_local_folder_on_a_cluster():
    assert _local_folder("app-1", "local[8]") == _local_folder("app-1", "local")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            _local_folder("app-2", master)
