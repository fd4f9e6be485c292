"""The date-partitioned posting table and the status log.

Both are append-only Parquet datasets; nothing is ever updated in place, so a failed or
repeated write is repaired by the anti-join of the next load (insert-only, idempotent).
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit import constants as K
from postkit.operators.dedup import dedup_first, not_stored
from postkit.operators.key_index import KeyIndex
from postkit.schemas import PARTITION_COLUMN, STATUS_OVERRIDE, WAREHOUSE, WAREHOUSE_COLUMNS
from postkit.session import path_exists


_exists = path_exists


def ensure_table(spark: SparkSession, path: str) -> None:
    """K4: create the empty table (schema + partition column) when absent."""
    if _exists(spark, path):
        return
    empty = spark.createDataFrame([], WAREHOUSE).withColumn(PARTITION_COLUMN, F.to_date("scraped_at"))
    empty.write.mode("append").partitionBy(PARTITION_COLUMN).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The whole table (readers prune columns and partitions)."""
    schema = T.StructType(WAREHOUSE.fields + [T.StructField(PARTITION_COLUMN, T.DateType())])
    return spark.read.schema(schema).parquet(path)


def existing_ids(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """Ids already loaded. Only an absent table reads as empty; other errors raise."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return read_table(spark, path).select(key)


def normalise_rows(df: DataFrame, loaded_at, now=None) -> tuple[DataFrame, DataFrame]:
    """P2 + P4 + X6 + Q2: warehouse-shaped rows and a quarantine of rows without a key.

    Missing columns and nulls take the column default; salary '' also when empty; a missing
    ``scraped_at`` becomes ``now``; status defaults to 'new'; one ``loaded_at`` for the batch.
    ``description`` and ``date_scraped`` are dropped; list columns are stored as JSON text."""
    now = loaded_at if now is None else now
    cols = set(df.columns)

    def get(name, default=None, cast=None):
        c = F.col(name) if name in cols else F.lit(None)
        if cast:
            c = c.cast(cast)
        return F.coalesce(c, F.lit(default)) if default is not None else c

    def as_text_list(name):
        if name not in cols:
            return F.lit("[]")
        dtype = dict(df.dtypes)[name]
        c = F.to_json(F.col(name)) if dtype.startswith("array") else F.col(name)
        return F.coalesce(c, F.lit("[]"))

    ts_now = F.lit(now).cast("timestamp")
    rows = df.select(
        get("job_id").cast("string").alias("job_id"),
        get("title", ""), get("company", ""), get("location", ""), get("url", ""), get("source", ""),
        F.coalesce(F.nullif(get("salary"), F.lit("")), F.lit("")).alias("salary"),
        F.coalesce(get("scraped_at", cast="timestamp"), ts_now).alias("scraped_at"),
        get("score", cast="bigint").alias("score"),
        get("match_summary", ""), as_text_list("skills_match").alias("skills_match"),
        as_text_list("gaps").alias("gaps"),
        get("seniority_match", cast="boolean").alias("seniority_match"),
        get("remote_match", cast="boolean").alias("remote_match"),
        get("status", K.DEFAULT_STATUS).alias("status"),
        F.lit(loaded_at).cast("timestamp").alias("loaded_at"),
    ).toDF(*WAREHOUSE_COLUMNS)
    good = rows.where(F.col("job_id").isNotNull() & (F.col("job_id") != ""))
    bad = rows.where(F.col("job_id").isNull() | (F.col("job_id") == "")).withColumn(
        "error", F.lit("missing job_id"))
    return good, bad


class LoadCounts(NamedTuple):
    """What a load did with its rows: appended, skipped (already loaded, or a repeat in the
    batch) and written to the quarantine."""
    inserted: int
    skipped: int
    quarantined: int


def quarantine_path(path: str) -> str:
    """Where rows that a load rejects are kept, next to the table."""
    return f"{path.rstrip('/')}_quarantine"


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Q2: every row that loads into ``path`` rejected, with its ``error``."""
    schema = T.StructType(WAREHOUSE.fields + [T.StructField("error", T.StringType())])
    if not _exists(spark, quarantine_path(path)):
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
    return spark.read.schema(schema).parquet(quarantine_path(path))


def new_rows(spark: SparkSession, batch: DataFrame, path: str, order_cols=("scraped_at",),
             key: str = "job_id", index: KeyIndex | None = None) -> DataFrame:
    """J3 + P12: in-batch first-wins dedup, then rows whose key is not loaded yet (by the bucketed ``index`` of the table's
    keys, if there is one)."""
    first = dedup_first(batch, key, [*order_cols, "url", "title"])
    if index is not None:
        index.refresh()
        return index.unseen(first)
    return not_stored(first, existing_ids(spark, path, key), key, batch)


def load_new(spark: SparkSession, scored: DataFrame, path: str, loaded_at=None, index: KeyIndex | None = None) -> LoadCounts:
    """K3: normalise, keep one row per unseen id, append into ``scraped_date`` partitions. Rows
    without a key are appended to the quarantine (Q2) before the load, so none is lost. The
    counts are observed during the writes (no second pass)."""
    loaded_at = loaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ensure_table(spark, path)
    good, bad = normalise_rows(scored, loaded_at)
    rejected, read, written = Observation("rejected"), Observation("read"), Observation("written")
    bad.observe(rejected, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(quarantine_path(path))
    todo = new_rows(spark, good.observe(read, F.count(F.lit(1)).alias("n")), path, index=index)
    # Rows of one date are gathered before the partitioned write, so a task does not write a
    # small file for every date it happens to hold. REBALANCE (not a plain repartition) lets AQE
    # split a hot date (a daily load is mostly one date) into advisory-sized files.
    out = (todo.withColumn(PARTITION_COLUMN, F.to_date("scraped_at")).hint("rebalance", PARTITION_COLUMN)
           .observe(written, F.count(F.lit(1)).alias("n")))
    out.write.mode("append").partitionBy(PARTITION_COLUMN).parquet(path)
    n = int(written.get["n"])
    return LoadCounts(n, int(read.get["n"]) - n, int(rejected.get["n"]))


def append_overrides(spark: SparkSession, overrides: DataFrame, path: str, at=None) -> None:
    """K5: append status overrides (``updated_at`` = ``at`` or now when absent). Rows without an
    id or a status go to the quarantine next to the log."""
    at_c = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    cols = set(overrides.columns)
    rows = overrides.select(
        F.col("job_id").cast("string"), F.col("status").cast("string"),
        (F.coalesce(F.col("updated_at").cast("timestamp"), at_c) if "updated_at" in cols else at_c).alias("updated_at"),
        (F.col("seq").cast("bigint") if "seq" in cols else F.lit(None).cast("bigint")).alias("seq"),
    )
    usable = F.col("job_id").isNotNull() & F.col("status").isNotNull()
    rows.where(~usable).withColumn("error", F.lit("missing job_id or status")).write.mode("append").parquet(quarantine_path(path))
    rows.where(usable).write.mode("append").parquet(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame | None:
    """The status log, or None when it does not exist (the view then uses base statuses)."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(STATUS_OVERRIDE).parquet(path)
