"""Counted cells of the current view, kept per date and refreshed only where something changed.

A cell counts the rows of a date that agree in everything a filter or metric looks at. Metrics over cells are those of
``report.py`` with the count as weight, for any filter but a search text. A refresh recomputes whole dates, those that a load or
a status change touched, and writes them as a folder of its own; readers take each date from the newest finished refresh that
covers it. A refresh that was killed leaves nothing that a reader sees, and the next one takes its number.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.functions.salary import with_salary
from postkit.operators.current import current_postings
from postkit.session import finished_folders

#: What filters and metrics look at; ``salary`` only says whether there is one.
CELL = ["date_scraped", "status", "source", "score", "remote_match", "salary", "salary_currency", "salary_min", "salary_max"]
WEIGHT = "n_rows"


def count_cells(view: DataFrame) -> DataFrame:
    """The cells of a view with parsed salaries (``with_salary``): the columns of CELL and ``n_rows``."""
    given = F.when(F.coalesce("salary", F.lit("")) != "", F.lit("given")).otherwise(F.lit(""))
    return view.withColumn("salary", given).groupBy(*CELL).agg(F.count(F.lit(1)).alias(WEIGHT))


def touched_dates(postings: DataFrame, batch: DataFrame | None = None, changes: DataFrame | None = None, key: str = "job_id") -> list[dt.date | None]:
    """The dates of the rows of ``batch``, and of the postings that ``changes`` (a status batch) names. One value a day."""
    dates = []
    if batch is not None:
        dates.append(batch.select(F.to_date("scraped_at").alias("d")))
    if changes is not None:
        dates.append(postings.join(changes.select(key).distinct(), key, "left_semi").select(F.to_date("scraped_at").alias("d")))
    return sorted({r.d for x in dates for r in x.distinct().collect()}, key=str)


class Rollup:
    """The cells kept at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str, numbers: list[int]) -> list[str]:
        return [f"{self.path}/{kind}/refresh={n}" for n in numbers]

    def refresh(self, postings: DataFrame, overrides: DataFrame | None, dates: list[dt.date | None] | None = None) -> None:
        """Counts the cells of ``dates`` anew (None: of all). With postings partitioned by ``scraped_date`` only these partitions
        are read."""
        if dates is not None and not dates:
            return
        day = F.col("scraped_date") if "scraped_date" in postings.columns else F.to_date("scraped_at")
        if dates is not None:
            some = day.isin([d for d in dates if d is not None])
            postings = postings.where(some | day.isNull() if None in dates else some)
        n = max(finished_folders(self.spark, f"{self.path}/dates", "refresh"), default=-1) + 1
        view = with_salary(current_postings(postings, overrides, ordered=False))
        cells, covered = self._folders("cells", [n])[0], self._folders("dates", [n])[0]
        count_cells(view).write.mode("overwrite").parquet(cells)
        held = self.spark.read.parquet(cells).select("date_scraped").distinct()
        asked = self.spark.createDataFrame([(d,) for d in dates or []], "date_scraped date")   # also those that hold no row any more
        held.unionByName(asked).distinct().coalesce(1).write.mode("overwrite").parquet(covered)

    def cells(self) -> DataFrame:
        """All cells, each date from the newest refresh that covers it."""
        done = finished_folders(self.spark, f"{self.path}/dates", "refresh")
        if not done:
            raise ValueError("nothing was refreshed yet")
        read = lambda kind: self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*self._folders(kind, done))
        newest = read("dates").groupBy("date_scraped").agg(F.max("refresh").alias("newest")).withColumnRenamed("date_scraped", "day")
        cells = read("cells")
        return cells.join(newest, F.col("date_scraped").eqNullSafe(F.col("day")) & (F.col("refresh") == F.col("newest"))).select(*CELL, WEIGHT)
