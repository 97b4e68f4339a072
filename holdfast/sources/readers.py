"""Typed readers. No schema is ever inferred."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast.schemas import ACTION_LOG_SCHEMA, EXPLANATION_SCHEMA, FEATURE_SCHEMA, RAW_SCHEMAS, ActivityTables
from holdfast.sources import folders

SUMMARY_SCHEMA = """
    simulation_assumptions struct<expected_retention_probability double, messaging_cost double,
        lifespan_months int, risk_threshold double>,
    portfolio_metrics struct<total_users_analyzed bigint, eligible_high_risk_users_targeted bigint,
        users_not_targeted_safe bigint, total_ltv_of_targeted_users double, total_expected_value_saved double,
        total_intervention_cost double, total_net_impact double, overall_program_roi_percentage double,
        positive_roi_users_count bigint, negative_roi_users_count bigint>,
    scenario_comparison struct<
        scenario_a_no_intervention struct<users_targeted double, expected_value_saved double,
            intervention_cost double, net_impact double>,
        scenario_b_retention_program struct<users_targeted double, expected_value_saved double,
            intervention_cost double, net_impact double, net_uplift_over_baseline double>>
"""


def csv_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV file, folder or list of them as text under the names of its header; files whose headers differ are refused."""
    names = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)


def typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema by name, in any order in the file; a cell that can't be read becomes NULL (see `load_report`)."""
    missing = [n for n in schema.names if n not in text.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return text.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema))


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    if fmt == "csv":
        return typed(csv_text(spark, path), schema)
    return spark.read.schema(schema).format(fmt).load(path)


BROKEN = "_broken_line"
TOO_FEW, TOO_MANY, BAD_VALUE = "too few cells", "too many cells", "bad value"


def _cells(line) -> F.Column:
    """Cells of a CSV line: separators outside of quotes, plus one."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.|"")*"', "")
    return F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","))) + 1


def checked_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line of a CSV table: its cells as text, `reason` why it can't be taken (NULL if it can), and `bad_cells`.

    A line breaks off or runs over if it has fewer or more cells than the header; a cell is bad if it isn't empty and can't
    be read as its column's type.
    """
    names = spark.read.option("header", True).csv(path).columns
    missing = [n for n in schema.names if n not in names]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    rows = spark.read.schema(text).options(header=True, enforceSchema=False, columnNameOfCorruptRecord=BROKEN).csv(path)
    count = _cells(F.col(BROKEN))
    bad = sum(((F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).cast("int") for f in schema), F.lit(0))
    whole = F.col(BROKEN).isNull()
    reason = F.when(count < len(names), TOO_FEW).when(count > len(names), TOO_MANY).when(whole & (bad > 0), BAD_VALUE)
    line = F.coalesce(F.col(BROKEN), F.to_csv(F.struct(*(F.col(f"`{n}`") for n in names))))
    return rows.select(*(F.col(f"`{n}`") for n in names), reason.alias("reason"), F.when(whole, bad).otherwise(0).alias("bad_cells"), line.alias("line"))


def load_checked(spark: SparkSession, folder: str, suffix: str = ".csv") -> tuple[dict[str, DataFrame], DataFrame]:
    """Raw tables of the lines that can be taken, typed, and the other lines as (table_name, reason, line) for a quarantine sink."""
    tables, rejected = {}, []
    for name, schema in RAW_SCHEMAS.items():
        rows = checked_csv(spark, f"{folder}/{name}{suffix}", schema)
        tables[name] = typed(rows.filter("reason IS NULL"), schema)
        rejected.append(rows.filter("reason IS NOT NULL").select(F.lit(name).alias("table_name"), "reason", "line"))
    return tables, reduce(DataFrame.unionByName, rejected)


def load_report(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """(table_name, rows_read, malformed_cells, too_few_cells, too_many_cells) of the raw CSV tables in a folder; the last two count lines."""
    parts = []
    for name, schema in RAW_SCHEMAS.items():
        rows = checked_csv(spark, f"{folder}/{name}{suffix}", schema)
        parts.append(rows.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows_read"),
            F.coalesce(F.sum("bad_cells"), F.lit(0)).cast("bigint").alias("malformed_cells"),
            F.count_if(F.col("reason") == TOO_FEW).alias("too_few_cells"), F.count_if(F.col("reason") == TOO_MANY).alias("too_many_cells"),
        ))
    return reduce(DataFrame.unionByName, parts)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table_name string, reason string, line string").json(path)


def read_published(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The version of a table that stands in its folder now (see `writers.publish`)."""
    version = folders.read(spark, f"{folder}/CURRENT").split()[0]
    return spark.read.schema(schema).parquet(f"{folder}/{version}")


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "csv") -> DataFrame:
    """One raw table with its declared schema."""
    return _read(spark, path, RAW_SCHEMAS[name], fmt)


def load_tables(spark: SparkSession, folder: str, fmt: str = "csv", suffix: str | None = None) -> dict[str, DataFrame]:
    """Raw tables found in a folder; a missing file is reported and skipped."""
    found = {}
    for name in RAW_SCHEMAS:
        path = f"{folder}/{name}{'.' + fmt if suffix is None else suffix}"
        try:
            found[name] = read_table(spark, name, path, fmt)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"{path} not found, table {name} skipped", stacklevel=2)
    return found


def activity_tables(found: dict[str, DataFrame]) -> ActivityTables:
    missing = [name for name in RAW_SCHEMAS if name not in found]
    if missing:
        raise ValueError(f"tables missing: {', '.join(missing)}")
    return ActivityTables(**found)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature table; Spark itself reports a missing path."""
    return _read(spark, path, FEATURE_SCHEMA, fmt)


def read_explanations(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested explanation records; multi_line reads one JSON array per file."""
    return spark.read.schema(EXPLANATION_SCHEMA).option("multiLine", multi_line).json(path)


def read_optional(spark: SparkSession, reader, path: str) -> DataFrame | None:
    """reader(spark, path), or None if the path does not exist."""
    try:
        return reader(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_summary(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).option("multiLine", multi_line).json(path)


def read_action_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the batches that the ledger names; batches that were never finished are not seen."""
    entries = folders.children(spark, f"{path}/ledger")
    if not entries:
        return spark.createDataFrame([], ACTION_LOG_SCHEMA)
    batches = [r["value"] for r in spark.read.text(f"{path}/ledger").collect()]  # one name per batch
    return typed(csv_text(spark, [f"{path}/batches/{b}" for b in batches]), ACTION_LOG_SCHEMA)
