"""Keyed state and the compacted status log."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from postkit.session import scratch_path
from postkit.streaming import changelog as C
from postkit.streaming import keyed_state as S

SEEN = "job_id string, at long, v string"


def test_first_arrivals_survive_restarts_and_late_repeats(spark):
    rows = spark.createDataFrame([("a", 3, "1"), ("a", 1, "1"), ("b", 2, "1"), (None, 5, "2"), ("a", 0, "2"), ("b", 1, "2"), ("c", 9, "3"), (None, 1, "3")]
                                 + [("hot", i, "1") for i in range(3000)], SEEN)
    out = S.run_stateful_dedup(spark, rows, [F.col("v") == "1", F.col("v") == "2", F.lit(True)], order_cols=("at",))
    assert sorted((r.job_id or "", r.at) for r in out.collect()) == [("", 5), ("a", 1), ("b", 2), ("c", 9), ("hot", 0)]
    assert not S.SETTINGS.items() <= dict(spark.sparkContext.getConf().getAll()).items()      # the session's own settings are back


def test_entries_expire(spark):
    landing, store, ckpt = (scratch_path(spark, n) for n in ("landing", "store", "ckpt"))
    for i in range(2):
        spark.createDataFrame([("a", i, "x")], SEEN).write.parquet(f"{landing}/d{i}")
        S.stateful_dedup(spark, f"{landing}/*", "job_id string, at long, v string", store, ckpt, order_cols=("at",), ttl_ms=500)
        time.sleep(1)
    assert sorted(r.at for r in spark.read.parquet(store).collect()) == [0, 1]


def entry(key, status, seq):
    return key, status, dt.datetime(2024, 1, 1) + dt.timedelta(hours=seq), seq


LOG = "job_id string, status string, updated_at timestamp, seq long"


def test_readers_merge_snapshot_and_tail(spark):
    path = scratch_path(spark, "log")
    assert C.read_latest(spark, path).collect() == [] and C.compact(spark, path) is None
    epochs = [[entry("a", "new", 1), entry("a", "seen", 3), entry("b", "new", 2)], [entry("a", "late", 2)], [entry("b", "done", 9)], [entry("c", "new", 1)]]
    for i, rows in enumerate(epochs):
        C.append_epoch(spark.createDataFrame(rows, LOG), path, i)
        if i == 1:
            assert C.compact(spark, path, every=3) is None and C.compact(spark, path) == 1
    want = {("a", "seen"), ("b", "done"), ("c", "new")}
    assert {(r.job_id, r.status) for r in C.read_latest(spark, path).collect()} == want
    rows, last = C.entries_since_snapshot(spark, path)
    files = sorted({f.split("/")[-2] for f in rows.inputFiles()})
    assert last == 3 and files == ["epoch=2", "epoch=3", "through=1"]                # the tail only
    C.append_epoch(spark.createDataFrame(epochs[3], LOG), path, 3)                   # a replayed epoch
    assert C.compact(spark, path) == 3 and C.prune(spark, path) == 5
    assert {(r.job_id, r.status) for r in C.read_latest(spark, path).collect()} == want


def test_an_unfinished_snapshot_is_not_read(spark):
    path = scratch_path(spark, "log")
    C.append_epoch(spark.createDataFrame([entry("a", "new", 1)], LOG), path, 0)
    C.compact(spark, path)
    C.append_epoch(spark.createDataFrame([entry("a", "seen", 2)], LOG), path, 1)
    folder = f"{path}/snapshots/through=1"
    spark.createDataFrame([entry("a", "half", 9)], LOG).write.parquet(folder)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, False)
    assert [r.status for r in C.read_latest(spark, path).collect()] == ["seen"]
    assert C.compact(spark, path) == 1                                               # started again
    assert [r.status for r in C.read_latest(spark, path).collect()] == ["seen"]


@pytest.mark.parametrize("null", ["job_id"])
def test_null_keys_are_a_key(spark, null):
    path = scratch_path(spark, "log")
    C.append_epoch(spark.createDataFrame([entry(None, "new", 1), entry(None, "seen", 2)], LOG), path, 0)
    assert [(r.job_id, r.status) for r in C.read_latest(spark, path).collect()] == [(None, "seen")]


def test_keys_of_a_bucket_share_one_call(spark):
    import pandas as pd
    from pyspark.sql import types as T

    class Entries(dict):
        def containsKey(self, key):
            return key in self

        def updateValue(self, key, value):
            self[key] = value

    class Handle:
        def getMapState(self, name, key, value, ttl_ms):
            return Entries()
    first = S.FirstArrival(T.StructField("job_id", T.StringType()), ["at"], None)
    first.init(Handle())
    frame = lambda rows: pd.DataFrame(rows, columns=["job_id", "at", "_bucket"])
    batches = [[("a", 3, 1), ("b", 2, 1), (None, 9, 1)], [("a", 1, 1), (None, 4, 1)]]
    (got,) = first.handleInputRows((1,), map(frame, batches), None)
    assert sorted((k or "", at) for k, at in got.itertuples(index=False)) == [("", 4), ("a", 1), ("b", 2)]
    (got,) = first.handleInputRows((1,), iter([frame([("a", 0, 1), ("c", 7, 1), (None, 1, 1)])]), None)
    assert list(got.itertuples(index=False, name=None)) == [("c", 7)]
    assert list(first.handleInputRows((1,), iter([frame([("c", 0, 1)])]), None)) == []
