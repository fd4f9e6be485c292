"""The current view = warehouse rows merged with the latest
status override per key, resolved at read time."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postkit.schemas import CURRENT_COLUMNS


def latest_by_key(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str]) -> DataFrame:
    """One row per key carrying ``value_cols`` of the row with the greatest ``order_cols``.

    Written as ``max(struct(order..., values...))`` per key: an aggregate, so every map task
    reduces its rows to one per key before the shuffle (a key holding a third of the log costs
    one row per task, not a third of the log in one task). Ties on the order columns are broken
    by the value columns, so the result is deterministic.
    """
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.max(F.struct(*[F.col(c) for c in list(order_cols) + list(value_cols)])).alias("_latest")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in value_cols])


def current_postings(postings: DataFrame, overrides: DataFrame | None = None, *,
                     key: str = "job_id", override_order: Sequence[str] = ("updated_at", "seq"),
                     since=None, ordered: bool = True, with_scraped_at: bool = False) -> DataFrame:
    """S5 + W1 + J1 + P5 (+ O1 when ``ordered``).

    ``postings`` is the warehouse table (``scraped_at`` timestamp); ``overrides`` the append-only
    status log or None when the log does not exist. ``since`` (a date) prunes partitions when the
    table is partitioned by ``scraped_date``.
    """
    base = postings
    if since is not None:
        part = "scraped_date" if "scraped_date" in postings.columns else None
        cond = (F.col(part) >= F.lit(since).cast("date")) if part else (F.to_date("scraped_at") >= F.lit(since).cast("date"))
        base = base.where(cond)
    base = base.withColumn("date_scraped", F.to_date("scraped_at"))
    status = F.col("status")
    if overrides is not None:
        order = [c for c in override_order if c in overrides.columns]
        latest = latest_by_key(overrides, key, order, ["status"]).withColumnRenamed("status", "_ov_status")
        base = base.join(latest, key, "left")
        status = F.coalesce(F.col("_ov_status"), F.col("status"))
    out = base.select(*[status.alias("status") if c == "status" else F.col(c) for c in CURRENT_COLUMNS],
                      "scraped_at")
    if ordered:
        out = out.orderBy(F.col("score").desc(), F.col("scraped_at").desc(), F.col(key))
    return out if with_scraped_at else out.select(*CURRENT_COLUMNS)


def apply_session_overrides(view: DataFrame, session: DataFrame, key: str = "job_id") -> DataFrame:
    """A small (job_id, status) frame applied on top of the view; missing keys keep theirs.

    The frame is deduplicated per key first (last value by ``seq`` when present) so the join
    can never multiply rows. AQE broadcasts it when its runtime size is under the threshold.
    """
    order = ["seq"] if "seq" in session.columns else []
    one = latest_by_key(session, key, order, ["status"]) if order else session.groupBy(key).agg(
        F.max("status").alias("status"))
    one = one.withColumnRenamed("status", "_sess_status")
    cols = [F.coalesce(F.col("_sess_status"), F.col("status")).alias("status") if c == "status" else F.col(c)
            for c in view.columns]
    return view.join(one, key, "left").select(*cols)
