"""K3, ST3, Q2: loads whose rows and rejects count once, together.

An epoch of a query writes its rows and its rejects to folders of its own and then a commit with its counts. Readers take
committed epochs only. A replay of an epoch that was not committed writes the same folders again; one that was is skipped. So
rows and rejects are exact wherever a load was killed, without a delete or a rename.

Loads of one table run one after another: each looks up the keys of the epochs committed before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.operators.dedup import dedup_first, not_stored
from postkit.operators.warehouse import LoadCounts, normalise_rows
from postkit.schemas import PARTITION_COLUMN, WAREHOUSE
from postkit.session import child_folders, finished_folders

_ROWS = T.StructType([*WAREHOUSE.fields, T.StructField(PARTITION_COLUMN, T.DateType())])
_REJECTS = T.StructType([*WAREHOUSE.fields, T.StructField("error", T.StringType())])
_COUNTS = "inserted long, skipped long, quarantined long"


class StagedTable:
    """The table at ``path``, date-partitioned inside each epoch; ``query`` names the writer (letters, digits, - and _)."""

    def __init__(self, spark: SparkSession, path: str, query: str = "load", key: str = "job_id"):
        self.spark, self.path, self.query, self.key = spark, path.rstrip("/"), query, key

    def _folder(self, kind: str, epoch: int, query: str | None = None) -> str:
        return f"{self.path}/{kind}/query={query or self.query}/epoch={epoch}"

    def committed(self) -> list[tuple[str, int]]:
        """(query, epoch) of every commit."""
        names = child_folders(self.spark, f"{self.path}/commits", "query=")
        return [(q, n) for q in names for n in finished_folders(self.spark, f"{self.path}/commits/query={q}", "epoch")]

    def _read(self, kind: str, schema: T.StructType) -> DataFrame:
        folders = [self._folder(kind, n, q) for q, n in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders).select(*schema.fieldNames())

    def rows(self) -> DataFrame:
        """The rows of all committed epochs."""
        return self._read("rows", _ROWS)

    def rejects(self) -> DataFrame:
        """Q2: the rejected rows of all committed epochs, with their ``error``."""
        return self._read("rejects", _REJECTS)

    def stage(self, batch: DataFrame, epoch: int, loaded_at) -> LoadCounts:
        """Writes the epoch's rejects and its new rows (first of each key, keys of committed epochs left out); no reader sees
        them yet."""
        good, bad = normalise_rows(batch, loaded_at)
        bad.write.mode("overwrite").parquet(self._folder("rejects", epoch))
        new = not_stored(dedup_first(good, self.key, ["scraped_at", "url", "title"]), self.rows(), self.key, good)
        (new.withColumn(PARTITION_COLUMN, F.to_date("scraped_at")).hint("rebalance", PARTITION_COLUMN)
         .write.mode("overwrite").partitionBy(PARTITION_COLUMN).parquet(self._folder("rows", epoch)))
        read = self.spark.read
        inserted = read.schema(_ROWS).parquet(self._folder("rows", epoch)).count()
        rejected = read.schema(_REJECTS).parquet(self._folder("rejects", epoch)).count()
        return LoadCounts(inserted, batch.count() - rejected - inserted, rejected)

    def commit(self, epoch: int, counts: LoadCounts) -> None:
        """The staged epoch counts from here on."""
        self.spark.createDataFrame([tuple(counts)], _COUNTS).coalesce(1).write.mode("overwrite").parquet(self._folder("commits", epoch))

    def load(self, batch: DataFrame, epoch: int, loaded_at) -> LoadCounts:
        """K3: one epoch, whole or not at all; the counts of its commit if it was loaded before."""
        if (self.query, epoch) in self.committed():
            return LoadCounts(*self.spark.read.schema(_COUNTS).parquet(self._folder("commits", epoch)).first())
        counts = self.stage(batch, epoch, loaded_at)
        self.commit(epoch, counts)
        return counts


def staged_load(spark: SparkSession, landing: str, schema, table: StagedTable, checkpoint: str, loaded_at) -> None:
    """ST3: one run over what landed since the last one, each micro-batch an epoch of ``table``."""
    q = (spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(lambda batch, epoch: table.load(batch, epoch, loaded_at) and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
