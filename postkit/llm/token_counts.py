"""Exact token statistics from a length histogram.

Documents are reduced to (encoded length, number of documents) by one aggregate that combines on
the map side, so a length shared by a third of all documents is one row per task. Suffix sums
over the histogram then answer, for every context limit, how many documents and tokens fit,
how many are cut, and how many tokens remain after truncation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths that share a block of the two-level running sums.
BLOCK = 1024


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``n_tokens``, ``n_docs``: one row per encoded length. A null length counts as 0."""
    return lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(
        F.count(F.lit(1)).alias("n_docs"))


def limit_table(hist: DataFrame) -> DataFrame:
    """For every encoded length as a context limit: ``n_docs`` of this length, ``docs_over`` and
    ``tokens_over`` (documents longer than it and their tokens), ``docs_within``,
    ``tokens_within``, ``truncated_total`` (tokens left when every document is cut at the
    limit) and ``quantile`` (share of documents within it). An empty histogram gives no rows.

    The running sums have two levels: blocks of lengths are summed first, each block's own sums
    run in a window of its own, and only the few block totals meet in one window.
    """
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
              .select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
                      F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
                      F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("all_tokens")))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = (h.join(blocks, "block")
         .withColumn("docs_over", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after"))
         .withColumn("tokens_over", F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_after")))
    return x.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("quantile"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """The same answers for given context limits, whether a document has that length or not."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"),
                     F.coalesce(F.sum(F.when(n > x, d)), F.lit(0)).alias("docs_over"),
                     F.coalesce(F.sum(F.least(n, F.lit(x)) * d), F.lit(0)).alias("truncated_total"),
                     F.coalesce(F.sum(n * d), F.lit(0)).alias("total")) for x in limits]
    return hist.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length within which at least each share of the documents lies (no documents: null)."""
    rows = [F.struct(F.lit(float(p)).alias("share"), F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias("n_tokens")) for p in shares]
    return limits.agg(F.array(*rows).alias("r")).select(F.inline("r"))
