"""The plans themselves: what is scanned, shuffled and evaluated where."""

import re

import pytest
from pyspark.sql import functions as F

from holdfast.operators import audits, explain, impact, prep, retention
from holdfast.operators.features import build_features
from holdfast.plans.workspace import workspace
from holdfast.sources.driver_tables import driver_spec, features_from_log, load_driver_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ws(spark, sf_dir):
    return workspace(spark, sf_dir)


@pytest.fixture(scope="module")
def feature_plan(spark, sf_dir):
    return plan(build_features(load_driver_tables(spark, sf_dir), driver_spec()))


def test_five_table_features_scan_the_log_per_table(feature_plan):
    # customer, and one scan of the events file per raw table derived from it
    assert feature_plan.count("FileScan parquet") == 5


def test_one_scan_plan_reads_the_log_once(spark, sf_dir):
    text = plan(features_from_log(spark, sf_dir, driver_spec()))
    assert text.count("FileScan parquet") == 2 and text.count("Exchange hashpartitioning") <= 3


def test_features_push_the_cutoff_and_prune_columns(feature_plan):
    assert "LessThan(ts,2024-01-30T00:00)" in feature_plan
    assert "props" not in feature_plan and "c_name" not in feature_plan


def test_features_stay_in_the_jvm(feature_plan):
    assert "Python" not in feature_plan and "Pandas" not in feature_plan


def test_every_shuffle_of_activity_follows_a_partial_aggregate(feature_plan):
    lines = feature_plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[i + 1]


def test_features_do_not_force_broadcasts(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(build_features(load_driver_tables(spark, sf_dir), driver_spec()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 4
    # users, the sessions' slots and users, and one shuffle for each other table
    assert len(re.findall("Exchange hashpartitioning", text)) == 6


def test_row_wise_operators_do_not_shuffle(ws):
    scored = ws.explained.withColumn("driver_1_feature", F.col("drivers")[0]["feature"])
    for df in (ws.scored, ws.attributed, ws.explained, retention.decide(scored), impact.impact_rows(scored)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_split_moves_counts_not_rows(ws):
    text = plan(prep.stratified_split(ws.features))
    top_join = text[:text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in top_join


def test_no_plan_has_a_cross_product(spark, sf_dir, ws):
    import __spark_entry__ as entry

    for name in ("feature_store", "stratified_split", "roc_auc", "label_distribution", "executive_kpis", "constraint_audit"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_constraints_read_each_table_once(ws):
    text = plan(audits.constraint_audit(ws.stored_tables))
    assert text.count("FileScan parquet") == 5 and "Join" not in text
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "props" not in text


def test_importance_is_one_small_exchange(ws):
    text = plan(explain.global_importance(ws.attributed))
    assert "hashpartitioning" not in text
