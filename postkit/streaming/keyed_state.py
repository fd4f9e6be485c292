"""ST1 / J5 by keyed streaming state: first arrival per key, remembered in the state store.

``incremental.first_wins_sink`` finds out by a join with the whole store what was seen before; here
every key that has arrived is an entry of a RocksDB state store, partitioned by buckets of keys, and
a run reads and writes the entries of its own rows only. An entry lives for ``ttl``: a repeat that comes
later is a new arrival. The sink is Spark's file sink, whose log and the state are committed with
the same epoch, so a run that is killed and started again adds no row twice and loses none.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postkit.session import scratch_path

#: Settings of a stateful run. A state with a time to live asks for another batch for ever, so a run that ends when the
#: landed files are read must not start batches without data; expired entries are dropped by the next run.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def _least(pdf: pd.DataFrame, key: Sequence[str], order: Sequence[str]) -> pd.DataFrame:
    """The first row of each key by ``order`` (nulls last)."""
    return pdf.sort_values(list(order), kind="stable", na_position="last").drop_duplicates(list(key), keep="first")


#: Groups that keys are dealt to. Handing a group to Python costs far more than asking for an entry, so keys share groups; the
#: number belongs to the state of a checkpoint and must not change under it.
BUCKETS = 2048


class FirstArrival(StatefulProcessor):
    """Gives the first row of every key of a bucket that has no entry yet, and makes the entries."""

    def __init__(self, key: T.StructField, order: Sequence[str], ttl_ms: int | None):
        self.key, self.order, self.ttl_ms = key, list(order), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("key", self.key.dataType)]),
                                       T.StructType([T.StructField("seen", T.BooleanType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:                                   # a hot key's rows come in batches; one row of each key is held
            best = _least(pdf if best is None else pd.concat([best, pdf]), [self.key.name], self.order)
        new = []
        for value in best[self.key.name].astype(object):
            entry = (None if pd.isna(value) else value,)
            new.append(not self.seen.containsKey(entry))
            if new[-1]:
                self.seen.updateValue(entry, (True,))
        if any(new):
            yield best[new].drop(columns="_bucket", errors="ignore")

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_arrivals(stream: DataFrame, key: str, order: Sequence[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream's first row per key. Rows are reduced to one per key and Arrow batch before they are shuffled, so a key that
    holds a third of all rows sends few. A null key is a key."""
    schema = stream.schema
    order = list(order)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _least(pdf, [key], order)

    dealt = stream.mapInPandas(reduced, schema).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=FirstArrival(schema[key], order, ttl_ms), outputStructType=schema, outputMode="append",
        timeMode="None" if ttl_ms is None else "processingTime")


def stateful_dedup(spark: SparkSession, landing: str, schema, store: str, checkpoint: str, key: str = "job_id",
                   order_cols: Sequence[str] = ("source_rank", "query_rank", "pos"), ttl_ms: int | None = None) -> None:
    """ST1: one run over newly landed raw postings, by keyed state. The number of state partitions is that of the first run."""
    with _settings(spark):
        src = spark.readStream.schema(schema).parquet(landing)
        q = (first_arrivals(src, key, order_cols, ttl_ms).writeStream.format("parquet").outputMode("append")
             .option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()


def run_stateful_dedup(spark: SparkSession, rows: DataFrame, drops: Sequence, key: str = "job_id", order_cols: Sequence[str] = ("doc_id",),
                       ttl_ms: int | None = 30 * 24 * 3600 * 1000) -> DataFrame:
    """One run per drop (a condition on ``rows``); returns the store."""
    landing, store, checkpoint = (scratch_path(spark, n) for n in ("landing", "store", "ckpt"))
    for i, drop in enumerate(drops):
        rows.where(drop).write.parquet(f"{landing}/d{i}")
        stateful_dedup(spark, f"{landing}/*", rows.schema, store, checkpoint, key, order_cols, ttl_ms)
    return spark.read.schema(rows.schema).parquet(store)
