"""ST4 + W1 + S7: a status log as snapshot plus tail.

The log is a folder per epoch. ``compact`` folds the newest snapshot and the epochs after it into
a new snapshot, one row per key, named after the last epoch it holds; ``read_latest`` merges the
newest finished snapshot with the epochs after it. A reader so costs the number of keys and the
entries since the last compaction, however long the log is. Epochs and snapshots are written
whole under their names and never changed, so a replayed epoch or a compaction that is started
again repeats nothing, and a reader between two steps sees one of the two states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.schemas import STATUS_OVERRIDE
from postkit.session import finished_folders, scratch_path


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/log"


def _snapshots(path: str) -> str:
    return f"{path.rstrip('/')}/snapshots"


def append_epoch(entries: DataFrame, path: str, epoch: int, key: str = "job_id") -> None:
    """Writes one epoch, reduced to the newest entry per key. A replay writes the same folder again."""
    _folded(entries, key).write.mode("overwrite").parquet(f"{_log(path)}/epoch={epoch}")


def land_overrides(spark: SparkSession, landing: str, schema, path: str, checkpoint: str, key: str = "job_id") -> None:
    """ST4: one run over newly landed overrides, each micro-batch an epoch. No state is kept: the log and its snapshots hold
    what a state store would."""
    q = (spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(lambda batch, epoch: append_epoch(batch, path, epoch, key))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _folded(entries: DataFrame, key: str) -> DataFrame:
    newest = entries.groupBy(key).agg(F.max(F.struct("updated_at", "seq", "status")).alias("_l"))
    return newest.select(key, "_l.status", "_l.updated_at", "_l.seq")


def entries_since_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest finished snapshot together with the epochs after it, and the last epoch there is (-1: none)."""
    done, epochs = finished_folders(spark, _snapshots(path), "through"), finished_folders(spark, _log(path), "epoch")
    through = done[-1] if done else -1
    tail = [e for e in epochs if e > through]
    folders = [f"{_snapshots(path)}/through={through}"] * bool(done) + [f"{_log(path)}/epoch={e}" for e in tail]
    rows = spark.read.schema(STATUS_OVERRIDE).parquet(*folders) if folders else spark.createDataFrame([], STATUS_OVERRIDE)
    return rows, max([through, *tail])


def read_latest(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The newest entry per key: snapshot and tail, merged by one aggregate that combines per task."""
    return _folded(entries_since_snapshot(spark, path)[0], key)


def compact(spark: SparkSession, path: str, key: str = "job_id", every: int = 1) -> int | None:
    """Writes a snapshot through the last epoch if at least ``every`` epochs came after the newest one; returns that epoch.
    Earlier snapshots and epochs stay until ``prune``."""
    done = finished_folders(spark, _snapshots(path), "through")
    rows, last = entries_since_snapshot(spark, path)
    if last - (done[-1] if done else -1) < every:
        return None
    _folded(rows, key).write.mode("overwrite").parquet(f"{_snapshots(path)}/through={last}")
    return last


def prune(spark: SparkSession, path: str) -> int:
    """Deletes epochs and snapshots that the newest finished snapshot replaces, for a job that knows that no reader is still
    on them; returns how many folders went."""
    done = finished_folders(spark, _snapshots(path), "through")
    if not done:
        return 0
    old = [f"{_log(path)}/epoch={e}" for e in finished_folders(spark, _log(path), "epoch") if e <= done[-1]]
    old += [f"{_snapshots(path)}/through={n}" for n in done[:-1]]
    for folder in old:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return len(old)


def run_compacted_log(spark: SparkSession, log: DataFrame, drops: int = 4, compact_after: tuple[int, ...] = (1, 2), key: str = "job_id") -> str:
    """The log in several drops (by ``seq``, not in order of time), one run each, compacted after some; returns its folder."""
    landing, path, checkpoint = (scratch_path(spark, n) for n in ("landing", "changelog", "ckpt"))
    for i in range(drops):
        log.where(F.pmod(F.col("seq"), F.lit(drops)) == i).write.parquet(f"{landing}/d{i}")
        land_overrides(spark, f"{landing}/*", log.schema, path, checkpoint, key)
        if i in compact_after:
            compact(spark, path, key)
    return path
