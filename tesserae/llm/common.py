"""Scratch tables, lineage cuts and row keys shared by the operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of our own where that is unset and Spark
    runs in one process (tests).  A cluster must name one: its executors do not see each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError(f"spark.checkpoint.dir names no shared folder, which {master} needs")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        folder = jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: later uses neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _returned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 22


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)`` whose tasks give the memory they freed back to the machine when they end.

    Python workers outlive their tasks, and allocators keep what was freed; several idle
    workers would otherwise hold the largest size each of them ever had.  Batches hold texts
    and sets, of which a task has several forms at once on both sides of the pipe: where the
    session has Spark's own limit on their bytes, it gets ``BATCH_BYTES``, once.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES) == "67108864b":
        conf.set(_BYTES, f"{BATCH_BYTES}b")
    return df.mapInArrow(lambda batches: _returned(f(batches)), schema)


def with_row(df: DataFrame) -> DataFrame:
    """``df`` with a key of its own for every row, so that null or repeated ids stay apart.

    The key is the row's place in the scan; it is stable over recomputation for
    tables and stored results, which is what the operators take.  How a scan is split
    must not follow the cores there are at the moment, which executors change as they
    come and go between two jobs: where it is unset, the session's least number of
    file partitions is set, once.
    """
    conf = df.sparkSession.conf
    if not conf.get("spark.sql.files.minPartitionNum", None):
        conf.set("spark.sql.files.minPartitionNum", str(parts(df.sparkSession)))
    return df.withColumn(ROW, F.monotonically_increasing_id())


def in_order(df: DataFrame, *order) -> DataFrame:
    """``df`` sorted as a whole by a range exchange and stored, with ``_part`` and ``_inside``: the number of
    the range and the row's place in it, from 0.  A range is never more than a task's share, so what
    runs along the order is scanned range by range and carried over from a row a range."""
    at = F.monotonically_increasing_id()
    kept = stored(df.orderBy(*order).withColumn("_at", at), "order")
    return kept.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_part"), F.expr("_at & 8589934591").alias("_inside"))


def masked(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their place, ``c0`` on, so that they clash with nothing; ``toDF(*df.columns)`` names them again."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined by ``keys`` with ``found``, a stored table of one row a key with the ``count`` of its rows.

    Keys that hold more than a quarter of a partition's share of ``rows``, of which there
    are four a partition at most whatever the data, are broadcast, so that no key gathers
    its rows in one task; the others are shuffled.  Without such keys one join does.  ``rows``
    are read twice or more, so they should be stored too.  Keys that are null meet nothing.
    """
    share = f"{count} * {4 * parts(rows.sparkSession)} > {rows.count()}"
    if not found.where(share).limit(1).count():
        return rows.join(found, keys)
    large = F.broadcast(found.where(share))
    cold = rows.join(large.select(*keys), keys, "left_anti").join(found.where(f"NOT ({share})"), keys)
    return rows.join(large, keys).unionByName(cold)


BROADCAST_ROWS = 1 << 22  # of two longs: about 100 MB as a hash table


def light(df: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast where it has few enough rows, so that the other side,
    which holds texts, is not shuffled for it; with more rows it is left as it is and the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
