"""The bucketed key index: stored keys are not shuffled, and the index never misses one."""

import pytest
from pyspark.sql import functions as F

from postkit.operators.key_index import KeyIndex
from postkit.session import scratch_path


def store_of(spark, path, low, high):
    spark.range(low, high).select(F.col("id").cast("string").alias("job_id"), (F.col("id") % 3).alias("day")).write.mode("append").partitionBy("day").parquet(path)


def test_only_the_batch_is_exchanged(spark):
    path = scratch_path(spark, "store")
    store_of(spark, path, 0, 5000)
    index = KeyIndex(spark, scratch_path(spark, "index"), path, buckets=4)
    index.refresh()
    batch = spark.range(6000).select(F.col("id").cast("string").alias("job_id"))
    for out, n in ((index.unseen(batch), 1000), (index.seen(batch), 5000)):
        assert out.count() == n
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert plan.index("Exchange") < plan.index("FileScan")          # above the batch, not the index


def test_catches_up_with_new_files_and_after_a_crash(spark, monkeypatch):
    path = scratch_path(spark, "store")
    index = KeyIndex(spark, scratch_path(spark, "index"), path, buckets=4)
    assert index.refresh() == 0 and index.keys().count() == 0           # no store yet
    store_of(spark, path, 0, 10)
    assert index.refresh() > 0 and index.refresh() == 0
    store_of(spark, path, 10, 20)
    log = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.refresh()                                                 # keys are written, the log is not
    monkeypatch.undo()
    assert spark.createDataFrame.__func__ is log.__func__
    assert index.refresh() > 0
    assert {r.job_id for r in index.keys().collect()} == {str(i) for i in range(20)}
    batch = spark.createDataFrame([("5",), ("25",), (None,), ("5",)], "job_id string")
    assert sorted(str(r.job_id) for r in index.unseen(batch).collect()) == ["25", "None"]


def test_an_index_outlives_the_catalog_entry(spark):
    path, at = scratch_path(spark, "store"), scratch_path(spark, "index")
    store_of(spark, path, 0, 10)
    first = KeyIndex(spark, at, path, buckets=4)
    first.refresh()
    spark.sql(f"DROP TABLE {first._name}")
    again = KeyIndex(spark, at, path, buckets=4)
    assert again.refresh() == 0 and again.keys().count() == 10
