"""What the corpus operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is named and there is no other machine (tests, a laptop) a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veranda-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder; later plans start from those files.

    What was shuffled to make them is garbage from here on; Spark's cleaner deletes those files once the driver's JVM has noticed, so it is
    asked to look now instead of whenever its heap fills."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Hands freed memory back to the system. Python workers outlive their tasks, and what their allocators keep for later
    counts against the executor while its JVM works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def start_task(encodes: bool) -> None:
    """Drops the encoders, with their memos, that an earlier operator's tasks left in this worker, unless this task encodes."""
    if not encodes:
        encoder.cache_clear()


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, encodes: bool = False) -> DataFrame:
    """mapInArrow whose workers give their memory back after each task. A row here is a whole document, so the session's batches are held to 1,000 rows
    unless its configuration names another number: a batch is held several times over, by the JVM and by the worker."""
    if not df.sparkSession.sparkContext.getConf().contains(ROWS):
        df.sparkSession.conf.set(ROWS, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_task(encodes)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_arrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return map_arrow(df, run, schema)


def map_groups(df: DataFrame, by: list[str], fn: Callable[[tuple, list[pa.Array]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn(key, other columns) of each group of rows with equal integers in the columns `by`, which come first; a group is whole in memory."""
    k = len(by)

    def told(held: list[pa.RecordBatch]) -> tuple[tuple, list[pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        return tuple(table.column(i)[0].as_py() for i in range(k)), [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[k:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(k)], 1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)])).tolist()
            for lo, hi in zip(starts, starts[1:]):
                if held and tuple(keys[lo]) != last:
                    yield from fn(*told(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = tuple(keys[lo])
        if held:
            yield from fn(*told(held))

    return map_arrow(df.repartition(*by).sortWithinPartitions(*by), run, schema)


def ids_in_buckets(df: DataFrame, column: str, ids: DataFrame, bits: int = 20) -> DataFrame:
    """Rows of df whose id may be in ids: a semi-join with the set of hashed ids, which has 2**bits values at most
    whatever the size of ids, so that it can be broadcast. Some other rows pass too; an exact join has to follow."""
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    few = ids.select(bucket(ids.columns[0]).alias("__bucket")).distinct()
    return df.withColumn("__bucket", bucket(column)).join(F.broadcast(few), "__bucket", "left_semi").drop("__bucket")


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id", bits: int = 20) -> DataFrame:
    """docs without the rows whose id is among ids, all columns as they are. Rows outside the ids' hash buckets (2**bits at
    most, hence broadcast) pass where they are read; only the few others are moved for the exact anti-join."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    few = F.broadcast(ids.select(bucket("__id").alias("__bucket")).distinct())
    keyed = docs.withColumn("__bucket", bucket(column))
    clear = keyed.join(few, "__bucket", "left_anti").select(*docs.columns)
    near = keyed.join(few, "__bucket", "left_semi")
    return clear.unionByName(near.join(ids, F.col(column) == F.col("__id"), "left_anti").select(*docs.columns))
