"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions sent to Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: Rows of one Arrow batch; texts are handled a batch at a time, so this bounds a worker's memory.
BATCH_ROWS = 512


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def arrow_batches(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_ROWS rows: ``fn`` gets an iterator of
    ``pyarrow.RecordBatch`` and yields such batches. Slicing a received batch is free, so a
    worker holds Python objects of BATCH_ROWS texts at a time, however long the partition."""
    rows = BATCH_ROWS

    def sliced(batches):
        def small():
            for b in batches:
                for i in range(0, b.num_rows, rows):
                    yield b.slice(i, rows)
        yield from fn(small())

    return df.mapInArrow(sliced, schema)


def broadcast_bytes(df: DataFrame, obj):
    """A broadcast variable of a driver-side object whose bound the caller has checked."""
    return df.sparkSession.sparkContext.broadcast(obj)


def set_apart(docs: DataFrame, own: Sequence[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn(docs)``, where all columns of ``docs`` but ``own`` go by other names (``extra_0``, ...) meanwhile and get theirs
    back in the result. So no column that an operator only passes on, however it is called, clashes with a working one."""
    names = {f"extra_{i}": c for i, c in enumerate(docs.columns) if c not in own}
    away = {c: x for x, c in names.items()}
    out = fn(docs.toDF(*[away.get(c, c) for c in docs.columns]))
    return out.toDF(*[names.get(c, c) for c in out.columns])


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """The field ``name`` of ``df`` as a nullable output field."""
    return T.StructField(alias or name, df.schema[name].dataType, True)
