"""The shared folder, measured broadcasts, and tables that are removed."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patchlake import runtime


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    bare = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(bare)


def test_rows_and_bytes_bound_a_broadcast(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("word"), F.lit(None)).alias("words"))
    assert runtime.small(df, 10, 20_000) and not runtime.small(df, 9, 20_000) and not runtime.small(df, 10, 5_000)
    assert runtime.small(df.limit(0), 0, 0)


def test_scratch_removes_its_tables_alone(spark):
    kept = runtime.materialize(spark.range(3).toDF("a"), "kept")
    with runtime.scratch(spark):
        gone = runtime.materialize(spark.range(3).toDF("a"), "gone")
        path = gone.inputFiles()[0].removeprefix("file://")
        assert gone.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
