"""ST1-ST4: incremental ingest, load and status log on Structured Streaming.

Each daily run is a ``trigger(availableNow=True)`` query over a landing folder with a
checkpoint in the shared checkpoint folder: it processes the files that arrived since the
last run and stops. Sinks are ``foreachBatch`` writers that anti-join their target first, so
a micro-batch replayed after a failure inserts nothing twice.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postkit.operators.current import latest_by_key
from postkit.operators.dedup import dedup_first, not_stored
from postkit.operators.scoring import score_postings
from postkit.operators.warehouse import _exists, load_new, read_table as read_warehouse
from postkit.session import scratch_path


def _run_available_now(stream_df: DataFrame, sink, checkpoint: str, output_mode: str = "append") -> None:
    q = (stream_df.writeStream.foreachBatch(sink).outputMode(output_mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def first_wins_sink(spark: SparkSession, store: str, key: str, order_cols: Sequence[str]):
    """ST1 sink: first arrival per key inside the batch, then only keys not yet stored."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        new = dedup_first(batch, key, order_cols)
        if _exists(spark, store):
            new = not_stored(new, spark.read.parquet(store), key, batch)
        new.write.mode("append").parquet(store)
    return sink


def incremental_dedup(spark: SparkSession, landing: str, schema, store: str, checkpoint: str,
                      key: str = "job_id", order_cols: Sequence[str] = ("source_rank", "query_rank", "pos")) -> None:
    """ST1: one run over newly landed raw postings."""
    src = spark.readStream.schema(schema).parquet(landing)
    _run_available_now(src, first_wins_sink(spark, store, key, order_cols), checkpoint)


def incremental_load(spark: SparkSession, landing: str, schema, table: str, checkpoint: str, loaded_at=None) -> None:
    """ST2/ST3: one run appending newly scored rows to the warehouse (insert-only)."""
    src = spark.readStream.schema(schema).parquet(landing)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        load_new(spark, batch, table, loaded_at)

    _run_available_now(src, sink, checkpoint)


class ScoreCounts(NamedTuple):
    """What one scoring run did: postings scored, and postings whose answer failed."""
    scored: int
    failed: int


def score_pending(spark: SparkSession, raw_path: str, scored_path: str, quarantine_path: str, profile: DataFrame,
                  scorer_factory, key: str = "job_id", keywords=None) -> ScoreCounts:
    """Scores every relevant raw posting that has no score yet: new ones and those whose answer
    failed in an earlier run. Answers are written once by ``score_postings``; scores and failures
    are appended, so a run that is repeated after a crash scores only what is still missing."""
    raw = spark.read.parquet(raw_path)
    done = spark.read.parquet(scored_path).select(key) if _exists(spark, scored_path) else raw.select(key).limit(0)
    kw = {} if keywords is None else {"keywords": keywords}
    good, bad = score_postings(raw, done, profile, scorer_factory, key, **kw)
    n_good, n_bad = Observation("scored"), Observation("failed")
    run = spark.read.parquet(quarantine_path).agg(F.max("run")).first()[0] if _exists(spark, quarantine_path) else None
    bad.withColumn("run", F.lit(0 if run is None else run + 1)).observe(n_bad, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(quarantine_path)
    good.observe(n_good, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(scored_path)
    return ScoreCounts(int(n_good.get["n"]), int(n_bad.get["n"]))


def incremental_score(spark: SparkSession, landing: str, schema, raw_path: str, scored_path: str, quarantine_path: str,
                      checkpoint: str, profile: DataFrame, scorer_factory, key: str = "job_id",
                      keywords=None, order_cols: Sequence[str] = ()) -> ScoreCounts:
    """ST2 + K2: one run. The stream lands what arrived since the last run in the raw store
    (first arrival per key); then everything without a score is scored. Rows whose answer fails
    are quarantined and stay unscored, so each later run retries them, new files or not."""
    incremental_dedup(spark, landing, schema, raw_path, checkpoint, key, order_cols)
    return score_pending(spark, raw_path, scored_path, quarantine_path, profile, scorer_factory, key, keywords)


def override_changelog(spark: SparkSession, landing: str, schema, changelog: str, checkpoint: str,
                       key: str = "job_id") -> None:
    """ST4: latest status per key as a streaming aggregate (state = one row per key, so no
    watermark is needed for correctness); every run appends the keys it changed."""
    src = spark.readStream.schema(schema).parquet(landing)
    agg = src.groupBy(key).agg(F.max(F.struct("updated_at", "seq", "status")).alias("_l"))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.select(key, "_l.updated_at", "_l.seq", "_l.status", F.lit(epoch_id).alias("epoch")) \
            .write.mode("append").parquet(changelog)

    _run_available_now(agg, sink, checkpoint, output_mode="update")


def read_latest(spark: SparkSession, changelog: str, key: str = "job_id") -> DataFrame:
    """Read side of ST4: newest entry per key across the appended updates."""
    return latest_by_key(spark.read.parquet(changelog), key, ["updated_at", "seq"], ["status"])


# ------------------------------------------------------------ two-drop runs used by queries

def _land(df: DataFrame, landing: str, part: str) -> None:
    df.write.mode("overwrite").parquet(f"{landing}/{part}")


def run_incremental_dedup(spark: SparkSession, rows: DataFrame, early,
                          key: str = "job_id", order_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Two daily drops (rows with ``early``, then the rest), two runs; returns the store."""
    landing, store, ckpt = (scratch_path(spark, n) for n in ("landing", "store", "ckpt"))
    for part, drop in (("d1", early), ("d2", ~early)):
        _land(rows.where(drop), landing, part)
        incremental_dedup(spark, f"{landing}/*", rows.schema, store, ckpt, key, order_cols)
    return spark.read.parquet(store)


def run_incremental_load(spark: SparkSession, rows: DataFrame, loaded_at) -> DataFrame:
    """Two drops of scored rows loaded by two runs, the second drop holding all rows again."""
    landing, table, ckpt = (scratch_path(spark, n) for n in ("landing", "table", "ckpt"))
    _land(rows.where(F.col("score") < 40), landing, "d1")
    incremental_load(spark, f"{landing}/*", rows.schema, table, ckpt, loaded_at)
    _land(rows, landing, "d2")
    incremental_load(spark, f"{landing}/*", rows.schema, table, ckpt, loaded_at)
    return read_warehouse(spark, table)


def run_incremental_score(spark: SparkSession, rows: DataFrame, early, profile: DataFrame, scorers: Sequence, key: str,
                          keywords) -> tuple[DataFrame, list[ScoreCounts]]:
    """Raw postings in two drops (those with ``early`` first), one run per scorer (the last ones
    without a new drop); returns the scored store and each run's counts."""
    landing, raw, scored, quarantine, ckpt = (scratch_path(spark, n) for n in ("landing", "raw", "scored", "quarantine", "ckpt"))
    counts = []
    for i, scorer in enumerate(scorers):
        if i < 2:
            _land(rows.where(early if i == 0 else ~early), landing, f"d{i + 1}")
        counts.append(incremental_score(spark, f"{landing}/*", rows.schema, raw, scored, quarantine, ckpt, profile, scorer, key, keywords))
    return spark.read.parquet(scored), counts


def run_override_stream(spark: SparkSession, log: DataFrame, key: str = "job_id") -> DataFrame:
    """The status log in two drops (later events first, to show lateness does not matter)."""
    landing, changelog, ckpt = (scratch_path(spark, n) for n in ("landing", "changelog", "ckpt"))
    mid = F.lit("2024-01-15 00:00:00").cast(log.schema["updated_at"].dataType)
    _land(log.where(F.col("updated_at") >= mid), landing, "d1")
    override_changelog(spark, f"{landing}/*", log.schema, changelog, ckpt, key)
    _land(log.where(F.col("updated_at") < mid), landing, "d2")
    override_changelog(spark, f"{landing}/*", log.schema, changelog, ckpt, key)
    return read_latest(spark, changelog, key)
