"""Writers: tables, CSV, JSON, versioned folders and the append-only action log."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.schemas import RAW_SCHEMAS
from holdfast.session import scratch_path
from holdfast.sources import folders


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested records, one JSON document per line; NULL fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


POINTER = "CURRENT"


def publish(df: DataFrame, folder: str, keep: int = 2) -> str:
    """Replaces a stored table in one step: the rows go to a new version folder, then a pointer file is renamed over the old one.

    Until the rename readers find the old rows, also if the write fails half-way; those who opened the old version
    before can finish, as the last `keep` versions stay. Returns the version's path.
    """
    spark = df.sparkSession
    before = folders.read(spark, f"{folder}/{POINTER}").split() if folders.exists(spark, f"{folder}/{POINTER}") else []
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    known = [name, *before][: max(1, keep)]
    folders.replace(spark, f"{folder}/{POINTER}", "\n".join(known))
    for old in set(before) - set(known):
        folders.delete(spark, f"{folder}/{old}")
    return f"{folder}/{name}"


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replaces the rows of a table of the catalog.

    Under a path the rows are published as a new version and the table's location is moved to it, one change in the
    catalog; queries that were planned before go on reading the version they know. Without a path the table is dropped and recreated, and
    until the new files stand, readers find none.
    """
    if path is None:
        df.write.mode("overwrite").saveAsTable(name)
        return
    spark, version = df.sparkSession, publish(df, path)
    if spark.catalog.tableExists(name) and spark.table(name).schema.simpleString() == df.schema.simpleString():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=version, source="parquet", schema=df.schema)
    spark.catalog.refreshTable(name)


def save_tables(tables: dict[str, DataFrame], database: str = "default", folder: str | None = None) -> DataFrame:
    """Recreates the raw tables, typed by their declared schema, and counts what is then in them."""
    counts = []
    for name, df in tables.items():
        save_table(df.select(*RAW_SCHEMAS[name].names), f"{database}.{name}", folder and f"{folder}/{name}")
        stored = df.sparkSession.table(f"{database}.{name}")
        counts.append(stored.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")))
    return reduce(DataFrame.unionByName, counts)


def append_action_log(log: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds the rows of one batch once; True if this call added them.

    The rows go to a folder of their own, then the batch's entry in the ledger is created. Only folders with an entry are
    read, and an entry can be created once: a repeated append of a batch, after a failure or beside another one, adds
    nothing. Without a batch id every call is a batch of its own.
    """
    spark, batch = log.sparkSession, batch or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"a batch id names a file: {batch!r}")
    entry = f"{path}/ledger/{batch}"
    if folders.exists(spark, entry):
        return False
    rows = f"{batch}-{uuid.uuid4().hex[:12]}"
    write_csv(log, f"{path}/batches/{rows}")
    added = folders.create(spark, entry, rows)
    if not added:
        folders.delete(spark, f"{path}/batches/{rows}")
    return added


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """A column `line` as text files that each begin with the header; nothing is quoted or changed."""
    plain = {"header": True, "sep": "\x01", "quote": "", "escapeQuotes": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.select(F.col("line").alias(header)).write.options(**plain).csv(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes to a new place in the shared folder and reads it back: the lineage ends in files."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
