"""Posting stores (raw and scored).

A store is a root folder of immutable versions (``version=000001``, ...). A rewrite (K1) always
writes a new version and never overwrites the path being read; readers take the newest one.
Legacy inputs (a JSON array file, JSON lines, parquet) are read with an explicit schema.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postkit.operators.current import latest_by_key
from postkit.schemas import RAW_POSTING

_VERSION = re.compile(r"version=(\d+)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    p, fs = _fs(spark, root)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    out = []
    for st in fs.listStatus(p):
        m = _VERSION.search(st.getPath().getName())
        if m and st.isDirectory():
            out.append((int(m.group(1)), st.getPath().toString()))
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_store(spark: SparkSession, path: str, schema=RAW_POSTING, on_missing: str = "empty",
               key: str = "job_id", last_wins: bool = True) -> DataFrame | None:
    """Read a store.

    ``on_missing``: 'empty' (S1, S3: an empty frame), 'error' (S2: raise), 'skip' (S4: None).
    A versioned root reads its newest finished version (written by ``write_store``: no duplicates).
    A legacy JSON array file is unsplittable (one task per file); duplicates inside it resolve
    to the *last* occurrence, by position within the file.
    """
    if not exists(spark, path):
        if on_missing == "error":
            raise FileNotFoundError(path)
        if on_missing == "skip":
            return None
        return spark.createDataFrame([], schema)
    versions = _versions(spark, path)
    done = [v for _, v in versions if exists(spark, f"{v}/_SUCCESS")]
    if versions:                                            # a version still being written is not one yet
        return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)
    if path.endswith(".json"):
        df = spark.read.schema(schema).option("multiLine", True).json(path)
    elif path.endswith(".jsonl"):
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.schema(schema).parquet(path)
    if not last_wins:
        return df
    # Position within a file = (file, start offset of the split, row id). A split is read in
    # order, so monotonically_increasing_id orders rows inside it; the split's start offset
    # orders the splits of one splittable file (JSON lines, parquet), whatever partition the
    # scan packed them into. A multiLine array file is a single split. Computed once, no join.
    pos = df.select("*", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_pos"))
    values = [c for c in df.columns if c != key]
    return latest_by_key(pos, key, ["_file", "_block", "_pos"], values).select(*df.columns)


def write_store(df: DataFrame, root: str) -> str:
    """K1: full rewrite as a new version next to the current one; returns its path."""
    spark = df.sparkSession
    versions = _versions(spark, root)
    nxt = (versions[-1][0] + 1) if versions else 1
    path = f"{root.rstrip('/')}/version={nxt:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path
