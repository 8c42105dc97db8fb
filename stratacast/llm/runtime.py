"""Shared-storage helpers: checkpoints and scratch tables that outlive lost executors.

Everything written here goes below the folder named by ``spark.checkpoint.dir``,
which driver and executors share, or below the warehouse where the session names none.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard, scratch_path, shared_dir, written

__all__ = ["broadcast_if_small", "checkpointed", "discard", "free_name", "read_table", "scratch_path", "small_batches", "spooled", "written"]

#: Bytes of values that one broadcast may carry.
BROADCAST_BYTES = 32 << 20
#: Bytes beyond which ``small_batches`` ends an Arrow batch, and rows that a Parquet reader decodes at once.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 64


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """For large rows: what runs within decodes few of them at once and sends them to Python in batches of about ``most`` bytes, of one row at least."""
    within = {"spark.sql.execution.arrow.maxBytesPerBatch": most, "spark.sql.parquet.columnarReaderBatchSize": BATCH_ROWS}
    before = {k: spark.conf.get(k, None) for k in within}
    try:
        for k, v in within.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def spooled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, for ``mapInArrow``, with its batches kept in a temporary file of the task until the input has ended.

    Where much goes both ways, JVM and worker could else each wait to send to the other over one socket.
    """

    def after_input(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            writer = None
            for batch in run(batches):
                writer = writer or pa.ipc.new_stream(file, batch.schema)
                writer.write_batch(batch)
            if writer:
                writer.close()
                file.seek(0)
                yield from pa.ipc.open_stream(file)

    return after_input


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def value_bytes(df: DataFrame) -> int:
    """Bytes that the values of ``df`` take, about: lengths of strings and arrays, 8 for anything else."""

    def of(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(x), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(x, F.lit(16).cast("long"), lambda n, v: n + of(v, kind.elementType).cast("long")), F.lit(16).cast("long"))
        return F.lit(8)

    each = sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, marked for broadcast if its values take ``most`` bytes at most.

    Beyond that it is returned as it is, and the planner shuffles both sides.
    """
    return F.broadcast(df) if value_bytes(df) <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
