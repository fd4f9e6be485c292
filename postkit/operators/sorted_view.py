"""O1, O2: a view kept in one of its sort orders, so that a page is a read of a few files instead of a sort.

The view is dealt into ranges of the sort order, each sorted and written as a part of its own. The number of rows before every
part is kept next to them; a page looks up the parts that its places fall into and reads these only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.operators.report import sort_columns
from postkit.session import scratch_path


class SortedView:
    """A view of this ``schema`` written by ``write`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    @classmethod
    def write(cls, view: DataFrame, path: str, sort_by: str, parts: int, key: str = "job_id") -> SortedView:
        """Sorts ``view`` by a named order (ties by ``key``, so a range of equal values can be split) into ``parts`` parts."""
        self, order = cls(view.sparkSession, path, view.schema), sort_columns(sort_by, key)
        placed = view.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        (placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
         .write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/rows"))
        counts = self._rows().groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")              # a row a part
        counts.select("_part", before.alias("before"), "n").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts")
        return self

    def _rows(self) -> DataFrame:
        places = [T.StructField("_pos", T.LongType()), T.StructField("_part", T.LongType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *places])).parquet(f"{self.path}/rows")

    def _parts(self) -> DataFrame:
        return self.spark.read.schema("_part long, before long, n long").parquet(f"{self.path}/parts")

    def _placed(self, rows: DataFrame, parts: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in ("_part", "_pos")]
        return rows.join(parts, "_part").select((F.col("before") + F.col("_pos") + 1).cast("bigint").alias("rank"), *columns)

    def all(self) -> DataFrame:
        """Every row with its place (``rank``, from 1)."""
        return self._placed(self._rows(), self._parts())

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of page ``number`` (from 1) with their places, in order. Only the parts that hold them are read."""
        first, last = (number - 1) * size + 1, number * size
        parts = self._parts().where((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
        held = [r["_part"] for r in parts.select("_part").collect()]                # at most a row a part
        placed = self._placed(self._rows().where(F.col("_part").isin(held)), parts)
        return placed.where(F.col("rank").between(first, last)).orderBy("rank")


def stored_orders(view: DataFrame, options, parts: int, key: str = "job_id") -> dict[str, SortedView]:
    """``view`` in each of the named orders, in fresh folders."""
    return {name: SortedView.write(view, scratch_path(view.sparkSession, "sorted"), name, parts, key) for name in options}
