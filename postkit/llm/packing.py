"""Packing documents into padded batches with optimal length buckets.

The histogram of encoded lengths is global and small; a dynamic programme over it chooses the
bucket boundaries with the least padding in total. (A ``step`` above 1 rounds the lengths up to
its multiples first: fewer boundaries to choose from, up to ``step`` - 1 more padding a document.) Inside
a bucket, documents in order of length form batches of as many as the token budget allows at
the bucket's padded length.

Documents are sorted by length and id once, in ranges, and written. A document's place is the number of documents in the
ranges before, which are few, plus its position in its own; its bucket's first place follows from the histogram. Rows that
agree in length and id are told apart by a number of their own, so even documents that are all of one length and without
an id are dealt over many ranges, and no bucket, length or id is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postkit.session import materialize


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds (the last is the longest length) with the least total
    padding, by dynamic programming. Costs satisfy the quadrangle inequality, so the best split
    moves monotonically and each layer is solved by divide and conquer."""
    size, n = np.asarray(lengths, np.int64), len(lengths)
    if n <= buckets:
        return [int(x) for x in size]
    docs = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(float)
    held = np.concatenate([[0], np.cumsum(size * np.asarray(counts, np.int64))]).astype(float)
    # cost(i, j): padding of one bucket with lengths i .. j-1 (0-based), bound size[j-1]
    layer = np.concatenate([[0.0], size * docs[1:] - held[1:]])
    splits = []
    for _ in range(buckets - 1):
        nxt, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        nxt[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = layer[i] + size[j - 1] * (docs[j] - docs[i]) - (held[j] - held[i])
            best = int(i[np.argmin(total)])
            nxt[j], arg[j] = total.min(), best
            stack += [(lo, j - 1, a, best), (j + 1, hi, best, b)]
        layer = nxt
        splits.append(arg)
    bounds, j = [], n
    for arg in reversed(splits):
        bounds.append(int(size[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    if j:
        bounds.append(int(size[j - 1]))
    return sorted(set(bounds))


def pack(lengths: DataFrame, budget: int = 65_536, buckets: int = 16, step: int = 1, id_col: str = "doc_id",
         length_col: str = "n_tokens") -> DataFrame:
    """One row per row of ``lengths`` (which should be a written table, it is read twice): id,
    ``n_tokens``, ``bucket`` (from 0), ``bucket_len`` (padded length), ``batch`` (from 0 in its
    bucket), ``slot`` (from 0 in its batch) and ``over_budget`` (alone in a batch since the
    bucket is longer than the budget). Documents are never cut or dropped.

    Null lengths count as 0; documents without tokens need no place and have null bucket,
    batch and slot. Rows with equal or null ids each get a place. Other columns are ignored, whatever their names. Empty
    tables give no rows.
    """
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    rows = lengths.select(F.col(id_col).alias("id"), n.alias("n_tokens")).withColumn("padded", (F.ceil(F.col("n_tokens") / step) * step).cast("long"))
    total = rows.groupBy("padded").agg(F.count(F.lit(1)).alias("n")).orderBy("padded").collect()   # one row per padded length
    held = [(r["padded"], r["n"]) for r in total if r["padded"] > 0]
    bounds = bucket_bounds([x for x, _ in held], [c for _, c in held], buckets)
    firsts = [sum(r["n"] for r in total if r["padded"] <= b) for b in [0, *bounds][:-1]]      # places before each bucket

    done = materialize(rows.withColumn("own", F.monotonically_increasing_id()).orderBy("padded", "id", "n_tokens", "own")
                       .select("id", "n_tokens", "padded", F.monotonically_increasing_id().alias("at")), "packing")
    done = done.withColumn("part", F.shiftright("at", 33))
    starts = done.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))      # one row per range
    bucket = F.when(F.col("padded") > 0, F.coalesce(*[F.when(F.col("padded") <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(None).cast("int")))
    of_bucket = lambda values: F.coalesce(*[F.when(F.col("bucket") == i, F.lit(v).cast("long")) for i, v in enumerate(values)], F.lit(None).cast("long"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (done.join(starts, F.col("part") == F.col("p")).withColumn("bucket", bucket).withColumn("bucket_len", of_bucket(bounds))
            .withColumn("place", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) - of_bucket(firsts))
            .select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len",
                    F.floor(F.col("place") / fits).cast("long").alias("batch"), F.pmod(F.col("place"), fits).cast("int").alias("slot"),
                    F.coalesce(F.col("bucket_len") > budget, F.lit(False)).alias("over_budget")))
