"""W2, J4, U-1, U-2, A9: first-seen-wins dedup, insert-if-absent, ingest counters.

Spark has no insertion order, so arrival order is explicit: ``order_cols`` (for extracted
postings ``source_rank, query_rank, pos``) must be unique within a key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _pick(df: DataFrame, key: Sequence[str], order_cols: Sequence[str], agg) -> DataFrame:
    """One row per key in one pass: the least (or greatest) struct of the order columns and then
    of all other columns, so rows that tie on the order still leave exactly one survivor. The
    aggregate combines on the map side: a key that holds a third of all rows leaves each task as
    one row. A null order value loses to any other."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    null_last = (lambda c: F.col(c).isNull()) if agg is F.min else (lambda c: F.col(c).isNotNull())
    types = {f.name: f.dataType for f in df.schema.fields}
    ranked = [x for i, c in enumerate(order_cols) for x in (null_last(c).alias(f"n{i}"), F.col(c).alias(f"o{i}"))]
    at = {c: f"o{i}" for i, c in reversed(list(enumerate(order_cols)))}
    for c in rest:
        if c not in at and _orderable(types[c]):
            at[c] = f"r{len(ranked)}"
            ranked.append(F.col(c).alias(at[c]))
    if all(c in at for c in rest):               # the ranked struct holds every column: each value crosses the shuffle once
        win = agg(F.struct(*ranked))
    else:
        win, at = (F.min_by if agg is F.min else F.max_by)(F.struct(*rest), F.struct(*ranked)), {c: c for c in rest}
    out = df.groupBy(*key).agg(win.alias("_v"))
    return out.select(*[F.col(c) if c in key else F.col(f"_v.{at[c]}").alias(c) for c in df.columns])


def dedup_first(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Per key keep the row that arrived first (least ``order_cols``; of rows that tie, the
    least in the remaining columns). Not ``dropDuplicates``, whose survivor is arbitrary. A null
    key is one key (as in a dict), and a null order value loses to any non-null one."""
    keys = [key] if isinstance(key, str) else list(key)
    return _pick(df, keys, order_cols, F.min)


def dedup_last(df: DataFrame, key: str | Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """S1 read rule for a stored file holding duplicates: the last occurrence wins."""
    keys = [key] if isinstance(key, str) else list(key)
    return _pick(df, keys, order_cols, F.max)


def with_arrival_rank(df: DataFrame, source_order: Sequence[str], source_col: str = "source") -> DataFrame:
    """U-1: literal ``source_rank`` from an ordered source list (unknown sources last)."""
    rank: Column = F.lit(len(source_order))
    for i, s in reversed(list(enumerate(source_order))):
        rank = F.when(F.col(source_col) == s, F.lit(i)).otherwise(rank)
    return df.withColumn("source_rank", rank)


def not_stored(rows: DataFrame, stored: DataFrame, key: str, batch: DataFrame | None = None) -> DataFrame:
    """Rows whose ``key`` is not among ``stored`` keys (a left anti join), for a store that grows
    every run while the batch stays small. The stored keys are first narrowed to the batch's
    keys with a semi join, whose small batch side Spark can broadcast (size-checked threshold,
    AQE at runtime), so the store's key column is scanned and filtered in place instead of
    shuffled by every load; the anti join then meets only the keys both sides share.
    ``batch`` supplies the keys when ``rows`` is costlier to compute twice (same key set)."""
    keys = (batch if batch is not None else rows).select(key).distinct()
    seen = stored.select(key).join(keys, key, "left_semi")
    return rows.join(seen, key, "left_anti")


def insert_new(store: DataFrame, batch: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` (first-wins within the batch) whose key is not in ``store``.
    The caller appends them (U-2) to the store; the store is never rewritten in place."""
    return not_stored(dedup_first(batch, key, order_cols), store, key, batch)


def merged_store(store: DataFrame, batch: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """U-2: store ∪ new rows, with ``is_new`` telling them apart (stored rows win)."""
    new = insert_new(store, batch, key, order_cols)
    cols = [c for c in store.columns]
    return store.select(*cols, F.lit(False).alias("is_new")).unionByName(
        new.select(*cols, F.lit(True).alias("is_new")))


def ingest_counters(batch: DataFrame, key: str, order_cols: Sequence[str], group_col: str = "source",
                    store: DataFrame | None = None) -> DataFrame:
    """Per group, rows fetched, rows inserted (first arrival of a key not already stored)
    and rows skipped as duplicates. One scan: rows are first reduced to one per (key, group)
    on the map side, and the winner of a key is the least of those few."""
    order = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(y for c in order_cols for y in (F.col(c).isNull(), F.col(c)))])
    per = batch.groupBy(key, group_col).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    place = F.struct("o", group_col)
    per = per.withColumn("first", place == F.min(place).over(Window.partitionBy(key)))
    if store is not None:
        seen = store.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct().withColumn("_seen", F.lit(True))
        per = per.join(seen, key, "left").withColumn("first", F.col("first") & F.col("_seen").isNull())
    return per.groupBy(group_col).agg(F.sum("n").alias("fetched"), F.count_if("first").alias("inserted")).withColumn(
        "skipped", F.col("fetched") - F.col("inserted"))
