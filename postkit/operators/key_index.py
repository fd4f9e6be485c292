"""A bucketed index of stored keys (J2, J3, S6): which keys does a growing store hold?

The index is a catalog table over its own folder, bucketed and sorted by the key. A join on the
key deals only the batch over the index's buckets; the stored side is read bucket by bucket, with
no exchange however large it grows.

The store stays the authority. Before it is used, the index catches up with the store's files that
it does not cover yet, and only their key column is read. What it covers is logged after the keys are
written, so a crash between the two repeats some keys (which an existence check does not notice) and
never misses one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.session import path_exists


class KeyIndex:
    """Keys of the Parquet store at ``store``, kept at ``path``. ``buckets`` is fixed when the index is made: about a
    bucket per 200 MB of keys expected."""

    def __init__(self, spark: SparkSession, path: str, store: str, key: str = "job_id", buckets: int = 64, key_type: str = "string"):
        self.spark, self.store, self.key = spark, store, key
        self._keys = f"{path.rstrip('/')}/keys-by-{buckets}"
        self._files = f"{path.rstrip('/')}/files"
        self._name = "key_index_" + hashlib.md5(self._keys.encode()).hexdigest()[:12]
        self._spec = f"(`{key}` {key_type}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self._keys}'"
        self._buckets, self._type = buckets, key_type
        # The catalog of a session need not outlive it; the folder does, and the entry is made again.
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name} {self._spec}")

    def _covered(self) -> set[str]:
        if not path_exists(self.spark, self._files):
            return set()
        return {r.file for r in self.spark.read.schema("file string").parquet(self._files).collect()}

    def refresh(self) -> int:
        """Adds the keys of the store's files that are not covered yet; returns the number of these files."""
        if not path_exists(self.spark, self.store):
            return 0
        new = sorted(set(self.spark.read.schema(T.StructType([])).option("recursiveFileLookup", "true").parquet(self.store).inputFiles()) - self._covered())
        if new:
            rows = self.spark.read.schema(f"`{self.key}` {self._type}").parquet(*new).where(F.col(self.key).isNotNull()).distinct()
            (rows.repartition(self._buckets, self.key).write.mode("append").format("parquet").bucketBy(self._buckets, self.key)
             .sortBy(self.key).saveAsTable(self._name, path=self._keys))
            self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(self._files)
        return len(new)

    def keys(self) -> DataFrame:
        """The stored keys; the bucketed scan."""
        self.spark.sql(f"REFRESH TABLE {self._name}")
        return self.spark.table(self._name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not stored (null keys are not)."""
        return rows.join(self.keys().hint("shuffle_merge"), self.key, "left_anti")

    def seen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is stored."""
        return rows.join(self.keys().hint("shuffle_merge"), self.key, "left_semi")
