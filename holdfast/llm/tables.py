"""What the operators share: reading a table, whole texts, and tasks that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from holdfast.session import scratch_path, ship_package
from holdfast.sources import folders

HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


_OPEN: list[list[str]] = []  # folders written in the blocks of `intermediate` that are open


def store(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes below the shared folder and reads back: lineage ends in files that survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate(spark: SparkSession):
    """Deletes what is stored in this block when it ends, but for tables stored with `keep`; nothing else may be read later."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            folders.delete(spark, path)


def release_memory() -> None:
    """Gives back what a Python worker has freed but still holds: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def hashed_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` of the distinct rows, those with the smallest hashes of all columns; stored, as models read it several times.

    The bound holds whatever repeats: only hashes are ranked, and equal rows come together before they move.
    """
    hashed = rows.withColumn("sample_hash", F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    border = hashed.select("sample_hash").distinct().orderBy("sample_hash").limit(most).agg(F.max("sample_hash")).first()[0]
    low = hashed.filter(F.col("sample_hash") <= F.lit(border)) if border is not None else hashed.limit(0)
    return store(low.groupBy("sample_hash").agg(*(F.first(f"`{c}`").alias(c) for c in rows.columns)).drop("sample_hash"), "sample")


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str | T.StructType) -> DataFrame:
    """Applies function to every Arrow batch; the package is shipped to the workers first."""
    ship_package(df.sparkSession)

    def run(batches):
        release_memory()
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


def text_slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that a slice holds about `most` bytes of text, or one longer row."""
    lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(starts, starts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def with_columns_of_text(docs: DataFrame, function: Callable[[list], list[pa.Array]], added: str) -> DataFrame:
    """Whole rows of docs with the columns that function computes from their texts; rows stay where they are."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("row"))
    names = [part.split()[0] for part in added.split(",")]

    def run(batch: pa.RecordBatch):
        for part in text_slices(batch, 1 << 20):
            extra = function(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("row"), *extra], ["text", "row", *names])

    out = map_batches(rows, run, T.StructType([*rows.schema, *T.StructType.fromDDL(added)]))
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns), *names)


def kept_by_text(docs: DataFrame, function: Callable[[list], pa.Array]) -> DataFrame:
    """Those whole rows of docs for whose text the function says true, whatever their columns are called."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))

    def run(batch: pa.RecordBatch):
        for part in text_slices(batch, 1 << 20):
            yield part.filter(function(part.column("text").to_pylist()))

    out = map_batches(rows, run, rows.schema)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
