"""Grouped prefix sums: a running total inside each group, without one window over a group."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postkit.session import materialize


def grouped_offsets(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str, out: str = "offset") -> DataFrame:
    """Adds ``out``: the sum of ``value_col`` over the rows of the same group that come before in ``order_cols`` (0 for the
    first; null values count as 0). Rows that tie on the order follow each other in some one order.

    The rows are sorted by group and order into ranges and written once, so a group of any size is dealt over many
    tasks. Level one sums inside a (range, group); level two runs over the sums of each group's ranges, of which there
    are at most as many as ranges."""
    groups, value = list(group_cols), F.coalesce(F.col(value_col), F.lit(0)).cast("bigint")
    done = materialize(df.orderBy(*groups, *order_cols).withColumn("_at", F.monotonically_increasing_id()), "offsets")
    done = done.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("_part", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = done.withColumn("_inside", F.coalesce(F.sum(value).over(before), F.lit(0)))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = done.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum")).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_p"))
    return inside.join(ranges, same).select(*df.columns, (F.col("_inside") + F.col("_earlier")).alias(out))
