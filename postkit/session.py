"""Session helpers: building a session for tests/bench and locating shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SCRATCH: list[str] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "postkit",
                  extra_conf: dict | None = None) -> SparkSession:
    """Session used by tests and the bench. On a cluster, use the cluster's session instead."""
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a private folder; on a cluster a
    driver's folder is not seen by the executors, so a missing setting is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="postkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this driver has made so far and return how many. For a caller
    that is done with every result that reads them (the bench after each query, a job at its
    end); folders of other drivers are not touched."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_SCRATCH)
    while _SCRATCH:
        path = fs_path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store Spark reads it from."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def child_folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """What follows ``prefix`` in the names of the entries of ``path`` that begin with it, sorted; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hpath)
    names = (s.getPath().getName() for s in found)
    return sorted(x[len(prefix):] for x in names if x.startswith(prefix))


def finished_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the finished folders ``path/name=n``."""
    numbers = sorted(int(x) for x in child_folders(spark, path, f"{name}=") if re.fullmatch(r"[0-9]+", x))
    return [n for n in numbers if path_exists(spark, f"{path}/{name}={n}/_SUCCESS")]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back: later
    plans that consume it several times (an aggregate and its join-back) read the written
    table instead of re-running an expensive upstream (Python parsing), and the lineage is cut
    so a lost executor does not recompute it. Used only after the costly step, on its output."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table. Column pruning and filter pushdown happen in the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def literal_frame(spark: SparkSession, rows, schema) -> DataFrame:
    """A small fixed table built from JVM literals (a LocalRelation: no Python-backed scan)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields])

